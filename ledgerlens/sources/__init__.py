"""Readers, writers and the retail view over star-schema tables."""
