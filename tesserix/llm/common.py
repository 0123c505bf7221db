"""Shared pieces: table access and let-bindings; cutting lineage comes from tesserix.shared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.shared import Scratch, cut, shared_dir

__all__ = ["SPACES", "Scratch", "cut", "let", "read", "salted", "shared_dir", "words"]

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row: a lambda over a one-element array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Maximal runs of non-space characters; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def salted(df: DataFrame) -> int:
    """Partitions a wide exchange of this session has."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
