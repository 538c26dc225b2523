"""Operators for building training corpora: filtering, deduplication, extraction, scanning and packing."""
