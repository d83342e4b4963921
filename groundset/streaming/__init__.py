"""Incremental forms of the record operators."""
