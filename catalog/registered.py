"""Imports every query module, which fills the registry."""

from catalog import (  # noqa: F401
    aggregating, checking, cleaning, joining, ruling, sources, streaming, windows,
)
from catalog.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
