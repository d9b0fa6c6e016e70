"""Queries over the given tables, each with the SQL it must equal."""
