"""Structured Streaming forms of three batch behaviours."""
