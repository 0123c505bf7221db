"""Snapshots, validity and retention filters, votes, precedence merges and estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserix.plans.base import EVENTS, events
from tesserix.plans.registry import register
from tesserix.sources import table

COUNTED = ("customer", "supplier", "part", "orders", "lineitem", "events", "documents")
#: Days that records of a kind are kept; other kinds stay.
RETENTION = {"view": 3, "click": 7, "error": 14}


@register("index_snapshot", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in COUNTED))
def index_snapshot(spark, sf):
    """Rows of each table; Parquet answers from its footers."""
    out = None
    for t in COUNTED:
        one = table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


@register("status_counts", """SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open,
count(*) FILTER (o_orderstatus = 'P') AS partial FROM orders GROUP BY 1""")
def status_counts(spark, sf):
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), is_("F").alias("finished"), is_("O").alias("open"), is_("P").alias("partial"))


@register("valid_at", """WITH v AS (SELECT o_custkey, o_orderkey, o_orderdate AS valid_at, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS invalid_at FROM orders)
SELECT o_custkey, o_orderkey FROM v WHERE valid_at <= TIMESTAMP '1996-06-01' AND (invalid_at IS NULL OR TIMESTAMP '1996-06-01' < invalid_at)""")
def valid_at(spark, sf):
    """The version of each customer that holds at a moment: start inclusive, end exclusive, null end open."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("a", "o_orderkey")
    at = F.lit("1996-06-01 00:00:00").cast("timestamp_ntz")
    v = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("a")).withColumn("z", F.lead("a").over(w))
    return v.filter((F.col("a") <= at) & (F.col("z").isNull() | (at < F.col("z")))).select("o_custkey", "o_orderkey")


_DAYS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in RETENTION.items())


@register("retention_by_kind", f"""WITH {EVENTS}, m AS (SELECT max(us) AS top FROM e) SELECT event_id, event_type FROM e, m
WHERE CASE event_type {_DAYS} END IS NULL OR us >= top - CASE event_type {_DAYS} END * 86400000000""")
def retention_by_kind(spark, sf):
    e = events(spark, sf)
    days = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in RETENTION.items()]).cast("long")
    top = e.agg(F.max("us").alias("top"))
    kept = e.join(F.broadcast(top)).filter(days.isNull() | (F.col("us") >= F.col("top") - days * F.lit(86_400_000_000)))
    return kept.select("event_id", "event_type")


@register("majority_vote", """SELECT p_brand, p_type, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)) WHERE r = 1""")
def majority_vote(spark, sf):
    """The commonest answer of each group; ties go to the first by name. Two aggregates, no window over raw rows."""
    n = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return n.groupBy("p_brand").agg(F.min(F.struct((-F.col("n")).alias("m"), "p_type")).alias("x")).select("p_brand", "x.p_type", (-F.col("x.m")).alias("n"))


@register("first_occurrence", f"WITH {EVENTS} SELECT user_id, event_type, min(event_id) AS event_id FROM e GROUP BY 1, 2")
def first_occurrence(spark, sf):
    return events(spark, sf).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@register("precedence_merge", """WITH a AS (SELECT l_orderkey AS k, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
b AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
SELECT coalesce(a.k, b.k) AS order_key, coalesce(a.cents, b.cents) AS cents, a.k IS NOT NULL AS from_items FROM a FULL JOIN b ON a.k = b.k""")
def precedence_merge(spark, sf):
    """Totals of the items where there are any, else those of the order."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    a = li.filter("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("a"))
    b = o.select(F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("b"))
    return a.join(b, "k", "full").select(F.col("k").alias("order_key"), F.coalesce("a", "b").alias("cents"), F.col("a").isNotNull().alias("from_items"))


@register("weighted_rate", """SELECT l_returnflag, round(sum(CAST(round(l_discount * 100) AS BIGINT) * CAST(l_quantity AS BIGINT)) / sum(CAST(l_quantity AS BIGINT)), 6) AS rate FROM lineitem GROUP BY 1""")
def weighted_rate(spark, sf):
    q = F.col("l_quantity").cast("long")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.round(F.col("l_discount") * 100).cast("long") * q) / F.sum(q), 6).alias("rate"))


@register("token_estimate", "SELECT source, sum(length(coalesce(text, '')) // 4)::BIGINT AS tokens, count(*) AS n FROM documents GROUP BY 1")
def token_estimate(spark, sf):
    t = F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(t).cast("long").alias("tokens"), F.count("*").alias("n"))
