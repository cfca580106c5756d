"""Queries over the given tables, one per operator, and the SQL they are checked against."""
