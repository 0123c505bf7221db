"""Predicate queries, joins, set operations and pass-through SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserix.operators import predicates as P
from tesserix.plans.base import EVENTS, events
from tesserix.plans.registry import register
from tesserix.shared import spread
from tesserix.sources import table

ORDERS = P.Select(
    {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text", "o_totalprice": "number", "o_orderpriority": "text"},
    {"price": (("o_totalprice", False), ("o_orderkey", True)), "name": (("o_orderkey", True),)},
)
PARTS = P.Select({"p_partkey": "number", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "number"}, {"size": (("p_size", False), ("p_partkey", True))})


@register("predicate_orders", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_totalprice >= 100000 AND o_custkey < 900 AND o_orderstatus <> 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def predicate_orders(spark, sf):
    where = {"o_totalprice_gte": 100000, "o_custkey_lt": 900, "o_orderstatus_not": "O", "o_orderpriority_in": ["1-URGENT", "2-HIGH"]}
    return P.select_where(table(spark, sf, "orders"), ORDERS, where).select("o_orderkey", "o_custkey", "o_orderpriority")


@register("predicate_like_regex", "SELECT p_partkey, p_name, p_type FROM part WHERE p_type ILIKE '%e%' AND regexp_matches(p_brand, '#[1-3]') AND p_size > 5")
def predicate_like_regex(spark, sf):
    return P.select_where(table(spark, sf, "part"), PARTS, {"p_type_like": "%E%", "p_brand_regex": "#[1-3]", "p_size_gt": 5}).select("p_partkey", "p_name", "p_type")


@register("predicate_scan_capped", """
WITH m AS (SELECT * FROM orders WHERE o_totalprice > 1000), r AS (SELECT * FROM m ORDER BY o_orderkey LIMIT 10000), n AS (SELECT least(count(*), 10001) AS n FROM m)
SELECT o_orderkey, o_totalprice, n > 10000 AS scan_capped, n > 25 AS truncated FROM r, n ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def predicate_scan_capped(spark, sf):
    out = P.capped_query(table(spark, sf, "orders"), ORDERS, {"o_totalprice_gt": 1000}, "o_orderkey", "price", 25)
    return out.select("o_orderkey", "o_totalprice", "scan_capped", "truncated")


@register("join_caller_counts", "SELECT p_partkey, p_brand, count(l_orderkey) AS callers, count(DISTINCT l_suppkey) AS suppliers FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL")
def join_caller_counts(spark, sf):
    """Items are counted by part first, a bounded number of them a task; parts that share a key and brand count as one."""
    items = spread(table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey"), "l_partkey")
    n = items.groupBy("l_partkey").agg(F.count("l_orderkey").alias("n"), F.countDistinct("l_suppkey").alias("s"))
    p = table(spark, sf, "part").groupBy("p_partkey", "p_brand").agg(F.count("*").alias("same"))
    j = p.join(n, F.col("p_partkey") == F.col("l_partkey"), "left")
    return j.select("p_partkey", "p_brand", (F.coalesce("n", F.lit(0)) * F.col("same")).alias("callers"), F.coalesce("s", F.lit(0)).alias("suppliers"))


@register("join_anti_unsynced", "SELECT c_custkey, c_name FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-01') ON c_custkey = o_custkey")
def join_anti_unsynced(spark, sf):
    """Customers without an order in two months, as sessions without a sync marker."""
    since = table(spark, sf, "orders").filter("o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-01'")
    return table(spark, sf, "customer").join(since, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@register("join_semi_sessions", f"WITH {EVENTS} SELECT event_id, user_id FROM e WHERE event_type = 'error' AND user_id IN (SELECT user_id FROM e WHERE event_type = 'signup' AND cents > 5000)")
def join_semi_sessions(spark, sf):
    e = events(spark, sf)
    return e.filter("event_type = 'error'").join(e.filter("event_type = 'signup' AND cents > 5000").select("user_id"), "user_id", "left_semi").select("event_id", "user_id")


@register("join_latest_version", "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def join_latest_version(spark, sf):
    last = F.max_by(F.struct("o_orderkey", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(last.alias("x")).select("o_custkey", "x.o_orderkey", "x.o_orderpriority")


@register("join_union_precedence", """
SELECT nk, 'customer' AS origin, max(c_custkey) AS id FROM (SELECT c_nationkey AS nk, c_custkey FROM customer) GROUP BY nk
UNION ALL SELECT s_nationkey, 'supplier', max(s_suppkey) FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey IS NOT NULL) GROUP BY s_nationkey""")
def join_union_precedence(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nk")).agg(F.max("c_custkey").alias("id")).withColumn("origin", F.lit("customer"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nk")).agg(F.max("s_suppkey").alias("id")).withColumn("origin", F.lit("supplier"))
    return c.unionByName(s.join(c, "nk", "left_anti")).select("nk", "origin", "id")


@register("join_full_composition", f"""WITH {EVENTS}, s AS (SELECT day, sum(cents) AS saved FROM e WHERE event_type = 'purchase' AND cents > 20000 GROUP BY day),
u AS (SELECT day, count(*) AS errors FROM e WHERE event_type = 'error' AND cents > 15000 GROUP BY day)
SELECT coalesce(s.day, u.day) AS day, coalesce(saved, 0)::BIGINT AS saved, coalesce(errors, 0) AS errors FROM s FULL JOIN u ON s.day = u.day""")
def join_full_composition(spark, sf):
    e = events(spark, sf)
    s = e.filter("event_type = 'purchase' AND cents > 20000").groupBy("day").agg(F.sum("cents").alias("saved"))
    u = e.filter("event_type = 'error' AND cents > 15000").groupBy("day").agg(F.count("*").alias("errors"))
    return s.join(u, "day", "full").select("day", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("errors", F.lit(0)).alias("errors"))


@register("join_unique_cascade", """
WITH n AS (SELECT p_name AS name, count(*) AS c, min(p_partkey) AS id FROM part GROUP BY 1), b AS (SELECT p_brand AS name, p_size AS size, count(*) AS c, min(p_partkey) AS id FROM part GROUP BY 1, 2)
SELECT p_partkey, CASE WHEN n.c = 1 THEN n.id WHEN b.c = 1 THEN b.id END AS target, CASE WHEN n.c = 1 THEN 'name' WHEN b.c = 1 THEN 'brand_size' ELSE 'ambiguous' END AS match_kind
FROM part LEFT JOIN n ON p_name = n.name LEFT JOIN b ON p_brand = b.name AND p_size = b.size""")
def join_unique_cascade(spark, sf):
    p = table(spark, sf, "part")
    n = p.groupBy("p_name").agg(F.count("*").alias("c1"), F.min("p_partkey").alias("id1"))
    b = p.groupBy("p_brand", "p_size").agg(F.count("*").alias("c2"), F.min("p_partkey").alias("id2"))
    j = p.join(n, "p_name", "left").join(b, ["p_brand", "p_size"], "left")
    return j.select(
        "p_partkey", F.when(F.col("c1") == 1, F.col("id1")).when(F.col("c2") == 1, F.col("id2")).alias("target"),
        F.when(F.col("c1") == 1, "name").when(F.col("c2") == 1, "brand_size").otherwise("ambiguous").alias("match_kind"),
    )


@register("join_nearest_index", f"""WITH {EVENTS}, b AS (SELECT user_id, k, min(event_id) AS err FROM e WHERE event_type = 'error' GROUP BY 1, 2)
SELECT s.event_id, b.k AS near_k, b.err FROM (SELECT * FROM e WHERE event_type = 'signup') s JOIN b ON s.user_id = b.user_id
QUALIFY row_number() OVER (PARTITION BY s.event_id ORDER BY abs(b.k - s.k), b.k DESC) = 1""")
def join_nearest_index(spark, sf):
    """Nearest k of the same user, a tie goes to the larger: two as-of looks, backward and forward, instead of a range join."""
    e = events(spark, sf)
    b = e.filter("event_type = 'error'").groupBy("user_id", "k").agg(F.min("event_id").alias("err"))
    both = e.filter("event_type = 'signup'").select("user_id", "k", "event_id", F.lit(None).cast("struct<k:bigint,err:bigint>").alias("hit"))
    both = both.unionByName(b.select("user_id", "k", F.lit(None).cast("long").alias("event_id"), F.struct("k", "err").alias("hit")))
    w = Window.partitionBy("user_id").orderBy("k")
    lo = F.last("hit", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    hi = F.first("hit", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    n = both.withColumn("lo", lo).withColumn("hi", hi).filter("event_id IS NOT NULL AND (lo IS NOT NULL OR hi IS NOT NULL)")
    up = F.col("lo").isNull() | (F.col("hi").isNotNull() & (F.col("hi.k") - F.col("k") <= F.col("k") - F.col("lo.k")))
    return n.select("event_id", F.when(up, F.col("hi.k")).otherwise(F.col("lo.k")).alias("near_k"), F.when(up, F.col("hi.err")).otherwise(F.col("lo.err")).alias("err"))


@register("set_operations", """
(SELECT c_nationkey AS k, 'both' AS kind FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL
(SELECT n_nationkey, 'unused' FROM nation EXCEPT (SELECT c_nationkey, 'unused' FROM customer UNION SELECT s_nationkey, 'unused' FROM supplier))""")
def set_operations(spark, sf):
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    return c.intersect(s).withColumn("kind", F.lit("both")).union(n.subtract(c.union(s)).withColumn("kind", F.lit("unused")))


REVENUE = """SELECT r_name, n_name, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, count(*) AS items
FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name, n_name HAVING count(*) > 10"""


@register("sql_passthrough", REVENUE)
def sql_passthrough(spark, sf):
    return P.passthrough(spark, REVENUE, {t: table(spark, sf, t) for t in ("region", "nation", "customer", "orders", "lineitem")}, 100_000)


@register("pricing_summary", """SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS BIGINT)) AS qty, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents,
round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_shipdate <= TIMESTAMP '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count("*").alias("n")
    )


@register("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def grouping_sets(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@register("cell_truncation", "SELECT doc_id, substr(text, 1, 80) AS cell, length(text) > 80 AS cut, length(text) AS full_chars FROM documents")
def cell_truncation(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 80).alias("cell"), (F.length("text") > 80).alias("cut"), F.length("text").cast("long").alias("full_chars"))


@register("group_split", "SELECT doc_id, CASE WHEN ascii(substr(md5(source), 1, 1)) < ascii('c') THEN 'test' ELSE 'train' END AS part FROM documents")
def group_split(spark, sf):
    """All rows of a source fall on one side, by the first digit of a digest."""
    return table(spark, sf, "documents").select("doc_id", F.when(F.ascii(F.substring(F.md5(F.col("source").cast("binary")), 1, 1)) < F.ascii(F.lit("c")), "test").otherwise("train").alias("part"))
