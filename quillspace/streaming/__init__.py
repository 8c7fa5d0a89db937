"""Incremental maintenance over streams."""
