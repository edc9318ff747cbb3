"""Retail customer analytics written as Spark DataFrame jobs."""

from ledgerlens.config import RetailConfig

__all__ = ["RetailConfig"]
