"""Readers for tables, file trees, stores and version-control history."""
