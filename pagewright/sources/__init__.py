"""Readers, writers and request parsing."""
