"""Relational operators: predicates, access, history, upsert, quality and profiling."""
