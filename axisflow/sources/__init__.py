"""Readers, writers and table assembly."""
