"""Prices and credits: tiers, carried savings, segments between compactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tiered(quantity: Column, tiers: list[tuple[int | None, int]]) -> Column:
    """Progressive price: (upper bound of the tier or None, rate)."""
    total, below = F.lit(0), 0
    for upper, rate in tiers:
        part = quantity - below if upper is None else F.least(quantity, F.lit(upper)) - below
        total = total + F.greatest(F.lit(0), part) * rate
        below = upper or below
    return total


def carried(df: DataFrame, key: list[str], order: list[str], saved: Column, is_turn: Column, resets: Column, ceiling: int) -> DataFrame:
    """Per turn: what rows saved earlier in its segment, oldest first, up to a ceiling.

    A prefix sum inside the segment replaces the join of rows with later turns.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    seg = df.withColumn("segment", F.sum(resets.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*key, "segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.coalesce(F.sum(saved).over(inside), F.lit(0))
    return seg.withColumn("_prefix", prefix).filter(is_turn).withColumn("carried", F.least(F.col("_prefix"), F.lit(ceiling))).drop("_prefix")


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share; null for no trials."""
    p = successes / n
    mid = p + z * z / (2 * n)
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    scale = 1 + z * z / n
    return (mid - half) / scale, (mid + half) / scale
