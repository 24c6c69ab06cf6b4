"""Readers for landed files and writers for output tables.

Each reader has two parts: a thin ``spark.read`` call and a parser that maps a
DataFrame of raw text to typed rows. Parsers never drop a malformed row
silently: they return it with a reason, or a caller asks for strict mode.
"""
