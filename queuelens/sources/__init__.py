"""Readers, writers and the raw document store."""
