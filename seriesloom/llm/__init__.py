"""Operators for building training data: one module per operator, plus small shared helpers.

Nothing outside this folder imports it.
"""
