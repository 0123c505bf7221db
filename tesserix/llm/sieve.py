"""A bitmap of numbers, for keeping rows that can't have a partner out of a shuffle.

The bitmap has BITS bits whatever the table, so what the driver and a task hold is bounded. A number in the table always passes; one that is
not passes if it shares its bit with one that is, so what passes still has to be joined. A null is a number like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserix.llm.common import cut

#: 2 MB at most: with 1.6 million numbers inside, one stranger in 11 passes.
BITS = 1 << 24
#: Bits of the bitmap of one row of a sieve, as bitmap_construct_agg makes it.
ROW_BITS = 8 * 4096


def _place(number: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(number), F.lit(bits))


def sieve(rows: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """_row, _bits: the bitmap of the column's values, in rows of ROW_BITS."""
    place = rows.select(_place(F.col(column), bits).alias("p")).selectExpr(f"p div {ROW_BITS} AS _row", f"p % {ROW_BITS} AS at")
    return cut(place.groupBy("_row").agg(F.bitmap_construct_agg("at").alias("_bits")))


def split(rows: DataFrame, column: str, bitmap: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The rows that pass, and those that don't; no row moves."""
    met = rows.withColumn("_place", _place(F.col(column), bits)).join(F.broadcast(bitmap), F.expr(f"_place div {ROW_BITS} = _row"), "left")
    byte = f"int(conv(hex(substring(_bits, int(_place % {ROW_BITS} div 8) + 1, 1)), 16, 10))"
    passes = F.expr(f"coalesce(shiftright({byte}, int(_place % 8)) & 1, 0) = 1")
    return met.filter(passes).select(*rows.columns), met.filter(~passes).select(*rows.columns)
