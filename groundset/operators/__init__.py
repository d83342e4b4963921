"""The library's operators, functions from DataFrame to DataFrame."""
