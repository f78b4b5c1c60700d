"""Readers, writers and the flat purchase table."""
