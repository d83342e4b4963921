"""Operators bound to tables: the queries of the library and their SQL twins."""
