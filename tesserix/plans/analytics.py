"""Event analytics: summaries, buckets, folds, windows and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserix.operators import credits as C
from tesserix.operators import sequences as S
from tesserix.plans.base import EVENTS, events
from tesserix.plans.registry import register
from tesserix.sources import table


@register("analytics_kpi", f"""WITH {EVENTS} SELECT day, event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum(cents)::BIGINT AS cents,
sum(CASE WHEN k > 50 THEN cents ELSE 0 END)::BIGINT AS high_cents, min(us) AS first_us, max(us) AS last_us,
arg_max(user_id, struct_pack(c := cents, i := -event_id)) AS top_user FROM e GROUP BY 1, 2""")
def analytics_kpi(spark, sf):
    return events(spark, sf).groupBy("day", "event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.sum("cents").alias("cents"), F.sum(F.when(F.col("k") > 50, F.col("cents")).otherwise(0)).alias("high_cents"),
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max_by("user_id", F.struct("cents", -F.col("event_id"))).alias("top_user"),
    )


@register("analytics_global", f"WITH {EVENTS} SELECT count(*) AS n, count(DISTINCT user_id) AS users, sum(cents)::BIGINT AS cents, round(avg(k), 4) AS avg_k, min(day) AS first_day, max(day) AS last_day FROM e")
def analytics_global(spark, sf):
    return events(spark, sf).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.sum("cents").alias("cents"), F.round(F.avg("k"), 4).alias("avg_k"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@register("analytics_buckets", f"""WITH {EVENTS} SELECT CASE WHEN cents < 1000 THEN '<10' WHEN cents < 5000 THEN '10-50' WHEN cents < 20000 THEN '50-200' ELSE '200+' END AS bucket,
event_type, count(*) AS n FROM e GROUP BY 1, 2""")
def analytics_buckets(spark, sf):
    b = F.when(F.col("cents") < 1000, "<10").when(F.col("cents") < 5000, "10-50").when(F.col("cents") < 20000, "50-200").otherwise("200+")
    return events(spark, sf).groupBy(b.alias("bucket"), "event_type").agg(F.count("*").alias("n"))


@register("analytics_top_per_class", f"""WITH {EVENTS} SELECT event_type, user_id, n, cents FROM (SELECT event_type, user_id, count(*) AS n, sum(cents)::BIGINT AS cents FROM e GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, cents DESC, user_id) <= 10""")
def analytics_top_per_class(spark, sf):
    g = events(spark, sf).groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    w = Window.partitionBy("event_type").orderBy(F.desc("n"), F.desc("cents"), "user_id")
    return g.withColumn("_r", F.row_number().over(w)).filter("_r <= 10").drop("_r")


@register("analytics_gap_filled", f"""WITH {EVENTS}, d AS (SELECT unnest(generate_series((SELECT min(day) FROM e)::DATE, (SELECT max(day) FROM e)::DATE, INTERVAL 1 DAY))::DATE::VARCHAR AS day),
g AS (SELECT day, sum(cents) AS c FROM e WHERE event_type = 'purchase' AND cents > 25000 GROUP BY day) SELECT d.day, coalesce(c, 0)::BIGINT AS cents FROM d LEFT JOIN g USING (day)""")
def analytics_gap_filled(spark, sf):
    e = events(spark, sf)
    span = e.agg(F.min("day").cast("date").alias("a"), F.max("day").cast("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day")).select(F.col("day").cast("string"))
    return days.join(e.filter("event_type = 'purchase' AND cents > 25000").groupBy("day").agg(F.sum("cents").alias("c")), "day", "left").select("day", F.coalesce("c", F.lit(0)).alias("cents"))


@register("analytics_percentile_index", f"""WITH {EVENTS}, r AS (SELECT event_type, cents, row_number() OVER (PARTITION BY event_type ORDER BY cents) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM e)
SELECT event_type, max(cents) FILTER (i = (95 * n) // 100) AS p95, max(cents) FILTER (i = (95 * (n - 1)) // 100) AS p95_inner, max(n) AS n FROM r GROUP BY 1""")
def analytics_percentile_index(spark, sf):
    """Both index definitions, from counts per distinct value: the window holds one row a value, not one an event."""
    v = events(spark, sf).groupBy("event_type", "cents").agg(F.count("*").alias("c"))
    w = Window.partitionBy("event_type")
    r = v.withColumn("upto", F.sum("c").over(w.orderBy("cents"))).withColumn("n", F.sum("c").over(w))
    at = lambda i: F.min(F.when(F.col("upto") > F.floor(i), F.col("cents")))
    return r.groupBy("event_type").agg(at(95 * F.col("n") / 100).alias("p95"), at(95 * (F.col("n") - 1) / 100).alias("p95_inner"), F.max("n").alias("n"))


@register("analytics_median", "SELECT o_orderpriority, o_orderstatus, median(o_custkey) AS mid, count(*) AS n FROM orders GROUP BY 1, 2")
def analytics_median(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.median("o_custkey").alias("mid"), F.count("*").alias("n"))


@register("session_collapse", f"WITH {EVENTS} SELECT user_id, day, event_id, event_type, cents FROM e QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY cents DESC, k DESC, us DESC, event_id) = 1")
def session_collapse(spark, sf):
    rank = F.struct("cents", "k", "us", (-F.col("event_id")).alias("i"))
    return events(spark, sf).groupBy("user_id", "day").agg(F.max_by(F.struct("event_id", "event_type", "cents"), rank).alias("x")).select("user_id", "day", "x.*")


@register("fold_three_ways", f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY us, event_id) AS a, row_number() OVER (PARTITION BY user_id, k ORDER BY us DESC, event_id DESC) AS z FROM e)
SELECT user_id, sum(CASE WHEN z = 1 THEN cents END)::BIGINT AS keep_last, sum(CASE WHEN a = 1 THEN cents END)::BIGINT AS keep_first,
(SELECT sum(m) FROM (SELECT max(cents) AS m FROM e q WHERE q.user_id = r.user_id GROUP BY q.k))::BIGINT AS field_max, count(DISTINCT k) AS messages FROM r GROUP BY user_id""")
def fold_three_ways(spark, sf):
    """user and k name a message: last row wins, first row wins, or the largest counter wins; one aggregate serves all three."""
    at = F.struct("us", "event_id")
    m = events(spark, sf).groupBy("user_id", "k").agg(F.max_by("cents", at).alias("l"), F.min_by("cents", at).alias("f"), F.max("cents").alias("m"))
    return m.groupBy("user_id").agg(F.sum("l").alias("keep_last"), F.sum("f").alias("keep_first"), F.sum("m").alias("field_max"), F.count("k").alias("messages"))


@register("trailing_windows", f"""WITH {EVENTS}, b AS (SELECT user_id, day, sum(cents) AS c FROM e GROUP BY 1, 2), t AS (SELECT max(day)::DATE AS d FROM e)
SELECT user_id, sum(CASE WHEN day::DATE >= d THEN c ELSE 0 END)::BIGINT AS d1, sum(CASE WHEN day::DATE >= d - 6 THEN c ELSE 0 END)::BIGINT AS d7, sum(CASE WHEN day::DATE >= d - 29 THEN c ELSE 0 END)::BIGINT AS d30 FROM b, t GROUP BY 1""")
def trailing_windows(spark, sf):
    e = events(spark, sf)
    b = e.groupBy("user_id", "day").agg(F.sum("cents").alias("c"))
    last = e.agg(F.max("day").cast("date").alias("d"))
    at = lambda n: F.sum(F.when(F.col("day").cast("date") >= F.date_sub("d", n), F.col("c")).otherwise(0))
    return b.join(F.broadcast(last)).groupBy("user_id").agg(at(0).alias("d1"), at(6).alias("d7"), at(29).alias("d30"))


@register("cost_history", f"""WITH {EVENTS}, r AS (SELECT user_id, event_type, cents, row_number() OVER w AS a, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us DESC, event_id DESC) AS z FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us, event_id))
SELECT user_id, event_type, max(cents) FILTER (a = 1) AS baseline, max(cents) FILTER (z = 2) AS previous, max(cents) FILTER (z = 1) AS latest,
greatest(0, max(cents) FILTER (a = 1) * count(*) - sum(cents))::BIGINT AS saved FROM r GROUP BY 1, 2""")
def cost_history(spark, sf):
    w = Window.partitionBy("user_id", "event_type").orderBy("us", "event_id")
    at = F.struct("us", "event_id")
    e = events(spark, sf).withColumn("prev", F.lag("cents").over(w))
    g = e.groupBy("user_id", "event_type").agg(F.min_by("cents", at).alias("baseline"), F.max_by("prev", at).alias("previous"), F.max_by("cents", at).alias("latest"), F.count("*").alias("n"), F.sum("cents").alias("s"))
    return g.select("user_id", "event_type", "baseline", "previous", "latest", F.greatest(F.lit(0), F.col("baseline") * F.col("n") - F.col("s")).alias("saved"))


TIERS = [(10, 30), (25, 20), (None, 10)]


@register("tiered_pricing", """SELECT l_suppkey, sum(least(q, 10) * 30 + greatest(0, least(q, 25) - 10) * 20 + greatest(0, q - 25) * 10)::BIGINT AS price,
sum(CASE WHEN q > 40 THEN q * 15 ELSE q * 12 END)::BIGINT AS premium FROM (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY 1""")
def tiered_pricing(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return li.groupBy("l_suppkey").agg(F.sum(C.tiered(F.col("q"), TIERS)).alias("price"), F.sum(F.when(F.col("q") > 40, F.col("q") * 15).otherwise(F.col("q") * 12)).alias("premium"))


@register("price_catalog_join", """SELECT p_brand, count(*) AS n, sum(CAST(l_quantity AS BIGINT) * coalesce(CASE WHEN p_type LIKE 'PROMO%' THEN 7 WHEN p_type LIKE 'STANDARD%' THEN 5 END, 3))::BIGINT AS cost
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def price_catalog_join(spark, sf):
    """Distinct types resolve once by prefix, the rates join back; unknown types take the default."""
    part, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    rate = part.select("p_type").distinct().withColumn("rate", F.when(F.col("p_type").startswith("PROMO"), 7).when(F.col("p_type").startswith("STANDARD"), 5))
    priced = part.join(rate, "p_type", "left")
    return li.join(priced, li["l_partkey"] == priced["p_partkey"]).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long") * F.coalesce("rate", F.lit(3))).alias("cost"))


@register("carry_credit", f"""WITH {EVENTS}, s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS segment FROM e),
t AS (SELECT t.event_id, t.user_id, t.segment, coalesce(sum(CASE WHEN r.event_type = 'purchase' THEN r.cents ELSE 0 END), 0) AS p FROM s t LEFT JOIN s r ON r.user_id = t.user_id AND r.segment = t.segment AND (r.us, r.event_id) < (t.us, t.event_id)
WHERE t.event_type = 'view' GROUP BY 1, 2, 3) SELECT event_id, user_id, segment::BIGINT AS segment, least(p, 20000)::BIGINT AS carried FROM t""")
def carry_credit(spark, sf):
    c = C.carried(events(spark, sf), ["user_id"], ["us", "event_id"], F.when(F.col("event_type") == "purchase", F.col("cents")).otherwise(0), F.col("event_type") == "view", F.col("event_type") == "signup", 20000)
    return c.select("event_id", "user_id", "segment", "carried")


@register("day_share", f"""WITH {EVENTS}, d AS (SELECT user_id, day, sum(cents) AS c FROM e GROUP BY 1, 2) SELECT user_id, day, c::BIGINT AS cents, round(c / sum(c) OVER (PARTITION BY user_id), 6) AS share FROM d""")
def day_share(spark, sf):
    d = events(spark, sf).groupBy("user_id", "day").agg(F.sum("cents").alias("cents"))
    return d.withColumn("share", F.round(F.col("cents") / F.sum("cents").over(Window.partitionBy("user_id")), 6))


@register("interval_latest_start", f"""WITH {EVENTS}, iv AS (SELECT event_id AS iid, user_id, us AS a, us + k * 3600000000 AS b FROM e WHERE event_type = 'signup')
SELECT e.event_id, iv.iid FROM e JOIN iv ON e.user_id = iv.user_id AND e.us >= iv.a AND e.us <= iv.b WHERE e.event_type = 'error' QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY iv.a DESC, iv.iid DESC) = 1""")
def interval_latest_start(spark, sf):
    """A row inside an interval of its user; of several the latest start. The interval key is cut to days, so the join is on (user, day)."""
    e = events(spark, sf)
    day_us = 86_400_000_000
    iv = e.filter("event_type = 'signup'").select(F.col("event_id").alias("iid"), "user_id", F.col("us").alias("a"), (F.col("us") + F.col("k") * 3_600_000_000).alias("b"))
    iv = iv.withColumn("slot", F.explode(F.sequence(F.floor(F.col("a") / day_us), F.floor(F.col("b") / day_us))))
    hit = e.filter("event_type = 'error'").withColumn("slot", F.floor(F.col("us") / day_us)).join(iv, ["user_id", "slot"]).filter("us >= a AND us <= b")
    return hit.groupBy("event_id").agg(F.max_by("iid", F.struct("a", "iid")).alias("iid"))


@register("fifo_positional", f"""WITH {EVENTS}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS pos FROM e WHERE event_type = 'click'), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS pos FROM e WHERE event_type = 'purchase')
SELECT a.user_id, pos, a.event_id AS turn_id, b.event_id AS row_id, b.cents FROM a JOIN b USING (user_id, pos)""")
def fifo_positional(spark, sf):
    e = events(spark, sf)
    a = e.filter("event_type = 'click'").select("user_id", "us", F.col("event_id").alias("turn_id"))
    b = e.filter("event_type = 'purchase'").select("user_id", F.col("us").alias("us2"), F.col("event_id").alias("row_id"), "cents")
    return S.positional_join(a, b, ["user_id"], ["us", "turn_id"], ["us2", "row_id"]).select("user_id", F.col("pos").cast("long").alias("pos"), "turn_id", "row_id", "cents")


@register("arm_gate", f"""WITH {EVENTS}, g AS (SELECT event_type AS arm, count(*) AS n, count(*) FILTER (k >= 50) AS ok FROM e GROUP BY 1)
SELECT arm, n, ok, round((ok / n + 3.8416 / (2 * n) - 1.96 * sqrt((ok / n * (1 - ok / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS lower, round((ok / n + 3.8416 / (2 * n) + 1.96 * sqrt((ok / n * (1 - ok / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS upper FROM g""")
def arm_gate(spark, sf):
    g = events(spark, sf).groupBy(F.col("event_type").alias("arm")).agg(F.count("*").alias("n"), F.count_if(F.col("k") >= 50).alias("ok"))
    lo, hi = C.wilson(F.col("ok"), F.col("n"))
    return g.select("arm", "n", "ok", F.round(lo, 6).alias("lower"), F.round(hi, 6).alias("upper"))


@register("paired_arms", """SELECT a.l_orderkey, a.l_linenumber, CAST(a.l_quantity AS BIGINT) AS base, CAST(b.l_quantity AS BIGINT) AS cand FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity > b.l_quantity""")
def paired_arms(spark, sf):
    """Neighbouring lines of an order as a pair, on two equi keys."""
    a = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("base"))
    b = a.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("base").alias("cand"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).filter("base > cand").select("l_orderkey", "l_linenumber", "base", "cand")


@register("period_compare", f"""WITH {EVENTS}, m AS (SELECT max(day)::DATE AS d FROM e), s AS (SELECT event_type, count(*) FILTER (day::DATE > d - 7) AS now_n, count(*) FILTER (day::DATE <= d - 7 AND day::DATE > d - 14) AS before_n FROM e, m GROUP BY 1)
SELECT event_type, now_n, before_n, CASE WHEN before_n > 0 THEN round((now_n - before_n) * 100.0 / before_n, 4) END AS delta_pct FROM s""")
def period_compare(spark, sf):
    e = events(spark, sf)
    d, day = F.col("d"), F.col("day").cast("date")
    s = e.join(F.broadcast(e.agg(F.max("day").cast("date").alias("d")))).groupBy("event_type").agg(F.count_if(day > F.date_sub(d, 7)).alias("now_n"), F.count_if((day <= F.date_sub(d, 7)) & (day > F.date_sub(d, 14))).alias("before_n"))
    return s.withColumn("delta_pct", F.when(F.col("before_n") > 0, F.round((F.col("now_n") - F.col("before_n")) * F.lit(100.0) / F.col("before_n"), 4)))


@register("explode_typed", f"""WITH {EVENTS}, x AS (SELECT event_type, unnest([{{'kind': 'cents', 'v': cents}}, {{'kind': 'k', 'v': k}}, {{'kind': 'over', 'v': cents - 10000}}]) AS s FROM e)
SELECT event_type, s.kind AS kind, count(*) AS n, sum(s.v)::BIGINT AS total FROM x WHERE s.v > 0 GROUP BY 1, 2""")
def explode_typed(spark, sf):
    part = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("v"))
    x = events(spark, sf).select("event_type", F.inline(F.array(part("cents", F.col("cents")), part("k", F.col("k")), part("over", F.col("cents") - 10000))))
    return x.filter("v > 0").groupBy("event_type", "kind").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@register("dominant_share", f"""WITH {EVENTS}, g AS (SELECT day, user_id, sum(cents) AS c FROM e GROUP BY 1, 2) SELECT day, arg_max(user_id, struct_pack(c := c, u := -user_id)) AS top_user, round(max(c) * 100.0 / sum(c), 4) AS pct FROM g GROUP BY day""")
def dominant_share(spark, sf):
    g = events(spark, sf).groupBy("day", "user_id").agg(F.sum("cents").alias("c"))
    return g.groupBy("day").agg(F.max_by("user_id", F.struct("c", -F.col("user_id"))).alias("top_user"), F.round(F.max("c") * F.lit(100.0) / F.sum("c"), 4).alias("pct"))


@register("chronological_halves", f"""WITH {EVENTS}, r AS (SELECT user_id, cents, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e)
SELECT user_id, round(avg(cents) FILTER (i <= greatest(1, n // 2)), 4) AS early, round(avg(cents) FILTER (i > greatest(1, n // 2)), 4) AS late FROM r GROUP BY 1""")
def chronological_halves(spark, sf):
    w = Window.partitionBy("user_id")
    r = events(spark, sf).withColumn("i", F.row_number().over(w.orderBy("us", "event_id"))).withColumn("h", F.greatest(F.lit(1), F.floor(F.count("*").over(w) / 2)))
    return r.groupBy("user_id").agg(F.round(F.avg(F.when(F.col("i") <= F.col("h"), F.col("cents"))), 4).alias("early"), F.round(F.avg(F.when(F.col("i") > F.col("h"), F.col("cents"))), 4).alias("late"))


# Sequences


@register("sequence_episodes", f"""WITH {EVENTS}, s AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS island FROM e WHERE event_type <> 'view')
SELECT user_id, island::BIGINT AS island, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, min(event_id) AS first_id FROM s WHERE event_type <> 'purchase' GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) FILTER (event_type = 'error') > 0""")
def sequence_episodes(spark, sf):
    """Views are transparent, purchases break; runs of two or more with an error are episodes."""
    s = S.islands(events(spark, sf).filter("event_type <> 'view'"), ["user_id"], ["us", "event_id"], F.col("event_type") == "purchase").filter("event_type <> 'purchase'")
    return s.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.min("event_id").alias("first_id")).filter("n >= 2 AND errors > 0")


@register("sequence_batches", f"""WITH {EVENTS}, l AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS ch FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY us, event_id) AS island FROM l) SELECT user_id, island::BIGINT AS island, any_value(event_type) AS event_type, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 2""")
def sequence_batches(spark, sf):
    s = S.runs(events(spark, sf), ["user_id"], ["us", "event_id"], "event_type")
    return s.groupBy("user_id", "island").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n")).filter("n >= 2")


@register("sequence_second_guess", f"""WITH {EVENTS} SELECT event_id, user_id FROM (SELECT *, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)) WHERE event_type = 'click' AND b = 'error' AND c = 'click'""")
def sequence_second_guess(spark, sf):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    return events(spark, sf).withColumn("b", F.lead("event_type").over(w)).withColumn("c", F.lead("event_type", 2).over(w)).filter("event_type = 'click' AND b = 'error' AND c = 'click'").select("event_id", "user_id")


@register("sequence_repeats", f"WITH {EVENTS} SELECT user_id, event_type, k, count(*) AS n FROM e GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def sequence_repeats(spark, sf):
    return events(spark, sf).groupBy("user_id", "event_type", "k").agg(F.count("*").alias("n")).filter("n >= 3")


@register("active_duration", f"""WITH {EVENTS}, g AS (SELECT user_id, event_type, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM e)
SELECT user_id, coalesce(sum(gap) FILTER (gap > 0 AND gap < 3600000000 AND event_type <> 'signup'), 0)::BIGINT AS active_us FROM g GROUP BY 1""")
def active_duration(spark, sf):
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    g = events(spark, sf).withColumn("gap", gap)
    return g.groupBy("user_id").agg(F.sum(F.when((F.col("gap") > 0) & (F.col("gap") < 3_600_000_000) & (F.col("event_type") != "signup"), F.col("gap")).otherwise(0)).alias("active_us"))


@register("sliding_limiter", f"""WITH {EVENTS} SELECT event_id, count(*) OVER w AS calls, (sum(k) OVER w)::BIGINT AS tokens, count(*) OVER w > 3 OR sum(k) OVER w > 150 AS limited FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""")
def sliding_limiter(spark, sf):
    e = events(spark, sf)
    calls, tok = S.sliding_sum(e, ["user_id"], "us", 86_400_000_000, F.lit(1)), S.sliding_sum(e, ["user_id"], "us", 86_400_000_000, F.col("k"))
    return e.select("event_id", calls.alias("calls"), tok.alias("tokens"), ((calls > 3) | (tok > 150)).alias("limited"))


@register("burst_zscore", f"""WITH {EVENTS}, d AS (SELECT user_id, day, count(*) AS n FROM e GROUP BY 1, 2), z AS (SELECT *, avg(n) OVER w AS m, stddev_samp(n) OVER w AS s FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, day, n, round((n - m) / s, 4) AS z FROM z WHERE s > 0 AND (n - m) / s > 2""")
def burst_zscore(spark, sf):
    return S.bursts(events(spark, sf).groupBy("user_id", "day").agg(F.count("*").alias("n")), "user_id", "day", 2)


@register("once_per_session", f"WITH {EVENTS} SELECT user_id, day, k, min(event_id) AS claim FROM e GROUP BY 1, 2, 3")
def once_per_session(spark, sf):
    return events(spark, sf).groupBy("user_id", "day", "k").agg(F.min("event_id").alias("claim"))


@register("bounded_ring", f"WITH {EVENTS} SELECT user_id, event_id, us FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) <= 5")
def bounded_ring(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("us"), F.desc("event_id"))
    return events(spark, sf).withColumn("_r", F.row_number().over(w)).filter("_r <= 5").select("user_id", "event_id", "us")


@register("tumbling_windows", f"WITH {EVENTS} SELECT (us // 3600000000) * 3600000000 AS start_us, event_type, count(*) AS n, sum(cents)::BIGINT AS cents FROM e GROUP BY 1, 2")
def tumbling_windows(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return g.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "cents")


@register("session_windows", f"""WITH {EVENTS}, l AS (SELECT *, CASE WHEN us - lag(us) OVER w < 43200000000 THEN 0 ELSE 1 END AS ch FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY us, event_id) AS sid FROM l) SELECT user_id, min(us) AS start_us, max(us) + 43200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_windows(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("at", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


@register("turn_episodes", """WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations)
SELECT conv_id, island::BIGINT AS island, count(*) AS turns, sum(length(text))::BIGINT AS chars, sum(length(text) // 4)::BIGINT AS tokens FROM s GROUP BY 1, 2""")
def turn_episodes(spark, sf):
    s = S.islands(table(spark, sf, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user")
    return s.groupBy("conv_id", "island").agg(F.count("*").alias("turns"), F.sum(F.length("text").cast("long")).alias("chars"), F.sum(F.floor(F.length("text") / 4)).alias("tokens"))
