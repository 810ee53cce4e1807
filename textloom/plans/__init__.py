"""Queries over the test tables, and SQL with the same results."""
