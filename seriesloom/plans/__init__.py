"""Operators put together into the jobs a user runs."""
