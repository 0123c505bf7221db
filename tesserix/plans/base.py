"""Typed views of the event table that several queries share, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.sources import table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, us (epoch microseconds), day, user_id, event_type, cents, k. Money is in whole cents, so sums are exact."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("ts").cast("date").cast("string").alias("day"),
        "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


EVENTS = """e AS (
  SELECT event_id, epoch_us(ts) AS us, CAST(ts AS DATE)::VARCHAR AS day, user_id, event_type,
    CAST(round(value * 100) AS BIGINT) AS cents, CAST(props->>'$.k' AS BIGINT) AS k FROM events
)"""


#: Two minutes, and the stretch of time that is one group of the window below.
_GAP, _STRETCH = 120_000_000, 600_000_000


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src -> dst: the user of a purchase and that of the next one of the day less than two minutes later.

    The next one is looked up within stretches of ten minutes; a row early in a stretch also stands at the end of the stretch
    before, where it is only looked at. So no task holds a day.
    """
    from pyspark.sql import Window

    stretch = F.floor(F.col("us") / _STRETCH)
    early = (F.col("us") % _STRETCH < _GAP) & (F.floor(F.col("us") / 86_400_000_000) == F.floor((F.col("us") - _GAP) / 86_400_000_000))
    p = events(spark, sf_dir).filter("event_type = 'purchase'").select("us", "event_id", "user_id", F.floor(F.col("us") / 86_400_000_000).alias("day"), F.explode(F.array_compact(F.array(F.struct(stretch.alias("part"), F.lit(False).alias("copy")), F.when(early, F.struct((stretch - 1).alias("part"), F.lit(True).alias("copy")))))).alias("at"))
    w = Window.partitionBy("day", "at.part").orderBy("us", "event_id")
    e = p.select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"), (F.lead("us").over(w) - F.col("us")).alias("gap"), "at.copy")
    return e.filter(f"NOT copy AND gap < {_GAP} AND src <> dst").select("src", "dst")


HOPS = EVENTS + """, hop AS (
  SELECT src, dst FROM (
    SELECT user_id AS src, lead(user_id) OVER w AS dst, lead(us) OVER w - us AS gap FROM e WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY day ORDER BY us, event_id)
  ) WHERE gap < 120000000 AND src <> dst
)"""
