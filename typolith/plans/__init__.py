"""Queries over the test tables: each binds operators to tables, beside the same in SQL."""
