"""Readers and writers of the engine's tables."""

from brindle.sources.tables import table

__all__ = ["table"]
