"""Readers and the library lifecycle."""
