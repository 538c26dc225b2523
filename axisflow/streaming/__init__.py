"""Curves and regimes kept up to date from streams of files."""
