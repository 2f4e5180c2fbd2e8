"""Every operator as a named query over the given tables."""

from homeledger.catalog import cleaning, dedup, extraction, monitoring, reads  # noqa: F401
from homeledger.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
