"""Registered queries: each runs an operator over the whole given tables, with
the SQL that must give the same rows."""
