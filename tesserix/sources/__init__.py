"""Readers. Every table is read through Spark's own sources, so any store Spark knows will do."""

from tesserix.sources.tables import TABLES, table

__all__ = ["TABLES", "table"]
