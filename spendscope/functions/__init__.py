"""Column expressions; all built-in functions, no Python UDF."""
