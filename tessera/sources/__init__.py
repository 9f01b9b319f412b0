"""Readers, writers, table mappings and the triple store."""
