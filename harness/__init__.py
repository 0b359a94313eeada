"""Test harness: logical tables on top of the given test tables, the registered
queries, and their SQL counterparts. Not needed to use the engine."""
