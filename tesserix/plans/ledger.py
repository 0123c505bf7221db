"""Savings ledger and session joins, over the event table read as ledger rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserix.operators import ledger as L
from tesserix.plans.base import EVENTS, events
from tesserix.plans.registry import register
from tesserix.sources import table

_MODEL = "CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN 'other' ELSE 'm' || (k % 3) END"
#: Expressions that mean the same to Spark and to the twin. Costs are whole millicents.
_ROW = (
    "event_id AS seq", "user_id AS session", "us", "day",
    "CASE event_type WHEN 'purchase' THEN NULL WHEN 'signup' THEN 'session_end' WHEN 'click' THEN 'routing' WHEN 'view' THEN 'output_style' ELSE CASE WHEN k % 2 = 0 THEN 'compaction' ELSE 'turn_cut' END END AS kind",
    "CASE k % 6 WHEN 0 THEN 'read' WHEN 1 THEN 'bash' WHEN 2 THEN 'code-search' WHEN 3 THEN 'cached get' WHEN 4 THEN 'memory' ELSE 'edit' END AS tool",
    "k * 10 - 100 AS tokens", "k % 4 AS calls", "cents % 50 AS calls_cost", "CASE WHEN k % 3 = 0 THEN NULL ELSE cents % 1000 END AS cost", f"{_MODEL} AS model",
    "cents % 5000 AS spend", "cents % 300 AS carry", "k * 7 AS carry_tokens",
)
RATES = (("m0", 3), ("m1", 15), ("m2", 1))
LEDGER = f"""{EVENTS}, led AS (SELECT {", ".join(_ROW)} FROM e), rate AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {r})" for m, r in RATES)}) AS t(model, rate)),
pr AS (SELECT led.*, kind IS NOT DISTINCT FROM 'compaction' AS reset, greatest(tokens, 0) AS tk, cost IS NOT NULL OR coalesce(rate, 0) > 0 AS known, rate FROM led LEFT JOIN rate ON led.model = rate.model),
prd AS (SELECT * EXCLUDE (reset, tk, known, rate), CASE WHEN NOT reset AND tk > 0 AND known THEN tk ELSE 0 END AS p_tokens, CASE WHEN reset OR tk <= 0 THEN 0 WHEN cost IS NOT NULL THEN greatest(cost, 0) WHEN known THEN tk * rate ELSE 0 END AS p_cost,
CASE WHEN reset THEN 0 ELSE greatest(calls, 0) END AS p_calls, CASE WHEN reset THEN 0 ELSE greatest(calls_cost, 0) END AS p_calls_cost, CASE WHEN NOT reset AND tk > 0 AND NOT known THEN tk ELSE 0 END AS unpriced FROM pr)"""


def ledger(spark, sf):
    return events(spark, sf).selectExpr(*_ROW)


def rates(spark):
    return spark.createDataFrame(list(RATES), "model string, rate long")


@register("savings_row_pricing", f"WITH {LEDGER} SELECT seq, p_tokens, p_cost, p_calls, p_calls_cost, unpriced FROM prd")
def savings_row_pricing(spark, sf):
    return L.priced(ledger(spark, sf), rates(spark)).select("seq", "p_tokens", "p_cost", "p_calls", "p_calls_cost", "unpriced")


_LEVER = "regexp_matches(replace(replace(lower(tool), '-', '_'), ' ', '_'), '^(read|search|memory)$|_read$|_search$|cache|_memory$|recall')"


@register("read_lever", f"WITH {LEDGER} SELECT tool, {_LEVER} AS reads, count(*) AS n FROM led GROUP BY 1, 2")
def read_lever(spark, sf):
    return ledger(spark, sf).groupBy("tool", L.read_lever(F.col("tool")).alias("reads")).agg(F.count("*").alias("n"))


_FOLD = f"""WITH {LEDGER}, sv AS (SELECT session, day, sum(p_cost + p_calls_cost) AS cost, sum(p_tokens + unpriced) AS tokens, sum(p_calls) AS calls, count(*) FILTER (p_cost + p_calls_cost > 0 OR p_tokens + unpriced > 0) AS turns,
coalesce(sum(greatest(coalesce(cost, 0), 0)) FILTER (kind IS NULL AND {_LEVER}), 0) AS read_cost, coalesce(sum(greatest(tokens, 0)) FILTER (kind IS NULL AND {_LEVER}), 0) AS read_tokens,
coalesce(sum(greatest(tokens, 0)) FILTER (kind = 'output_style'), 0) AS output_tokens, coalesce(sum(greatest(coalesce(cost, 0), 0)) FILTER (kind = 'output_style'), 0) AS output_cost, coalesce(sum(p_calls) FILTER (kind = 'turn_cut'), 0) AS turns_avoided, max(us) AS lastus
FROM prd WHERE kind IS NULL OR kind NOT IN ('session_end', 'routing') GROUP BY 1, 2),
ro AS (SELECT session, day, sum(greatest(cost, 0)) AS routing, max(us) AS lastus FROM led WHERE kind = 'routing' GROUP BY 1, 2),
en AS (SELECT * FROM led WHERE kind = 'session_end' QUALIFY row_number() OVER (PARTITION BY session ORDER BY us DESC, seq DESC) = 1),
la AS (SELECT session, max(lastus) AS lastus FROM (SELECT session, lastus FROM sv UNION ALL SELECT session, lastus FROM ro) GROUP BY 1), al AS (SELECT session, sum(tokens) AS total FROM sv GROUP BY 1),
es AS (SELECT en.*, total, coalesce(lastus > us, false) AS resumed FROM en LEFT JOIN la USING (session) LEFT JOIN al USING (session)),
tu AS (SELECT user_id AS session, day, sum(cents % 77) AS spend FROM e WHERE event_type = 'view' AND user_id % 2 = 0 GROUP BY 1, 2),
se AS (SELECT session FROM sv UNION SELECT session FROM ro UNION SELECT session FROM en),
sp AS (SELECT session, day, spend FROM es WHERE spend > 0 AND (NOT resumed OR session NOT IN (SELECT session FROM tu)) UNION ALL
SELECT session, day, spend FROM tu WHERE session IN (SELECT session FROM se) AND session NOT IN (SELECT session FROM es WHERE spend > 0 AND NOT resumed)),
ca AS (SELECT sv.session, sv.day, es.carry * (sv.tokens / total) AS carry, es.carry_tokens * (sv.tokens / total) AS carry_tokens FROM sv JOIN es USING (session) WHERE sv.tokens > 0 UNION ALL SELECT session, day, carry, carry_tokens FROM es WHERE coalesce(total, 0) = 0),
ky AS (SELECT session, day FROM sv UNION SELECT session, day FROM ro UNION SELECT session, day FROM sp UNION SELECT session, day FROM ca),
fo AS (SELECT session, day, coalesce(cost, 0)::BIGINT AS cost, coalesce(tokens, 0)::BIGINT AS tokens, coalesce(calls, 0)::BIGINT AS calls, coalesce(turns, 0)::BIGINT AS turns, coalesce(sp.spend, 0)::BIGINT AS spend, round(coalesce(ca.carry, 0), 4) AS carry, coalesce(routing, 0)::BIGINT AS routing,
coalesce(read_cost, 0)::BIGINT AS read_cost, coalesce(read_tokens, 0)::BIGINT AS read_tokens, round(coalesce(ca.carry_tokens, 0), 4) AS carry_tokens, coalesce(output_tokens, 0)::BIGINT AS output_tokens, coalesce(output_cost, 0)::BIGINT AS output_cost, coalesce(turns_avoided, 0)::BIGINT AS turns_avoided
FROM ky LEFT JOIN sv USING (session, day) LEFT JOIN ro USING (session, day) LEFT JOIN sp USING (session, day) LEFT JOIN ca USING (session, day))"""


def _fold(spark, sf):
    turns = events(spark, sf).filter("event_type = 'view' AND user_id % 2 = 0").selectExpr("user_id AS session", "day", "cents % 77 AS cost")
    return L.day_fold(ledger(spark, sf), turns, rates(spark))


@register("savings_day_fold", f"{_FOLD} SELECT * FROM fo")
def savings_day_fold(spark, sf):
    return _fold(spark, sf)


@register("savings_open_interval", f"""{_FOLD} SELECT day, sum(cost)::BIGINT AS cost, sum(tokens)::BIGINT AS tokens, sum(calls)::BIGINT AS calls, sum(turns)::BIGINT AS turns, sum(turns_avoided)::BIGINT AS turns_avoided, sum(spend)::BIGINT AS spend, sum(output_tokens)::BIGINT AS output_tokens
FROM fo WHERE day > '2024-01-05' AND day < '2024-01-20' AND session % 10 <> 9 GROUP BY 1""")
def savings_open_interval(spark, sf):
    """Days strictly between two; sessions that only patch an account are left out."""
    f = _fold(spark, sf).filter("day > '2024-01-05' AND day < '2024-01-20' AND session % 10 <> 9")
    return f.groupBy("day").agg(*[F.sum(c).alias(c) for c in ("cost", "tokens", "calls", "turns", "turns_avoided", "spend", "output_tokens")])


@register("usage_by_first_day", f"WITH {EVENTS}, s AS (SELECT user_id, min(day) AS day, count(*) AS n, sum(cents) AS cents FROM e GROUP BY 1) SELECT day, count(*) AS sessions, sum(n)::BIGINT AS n, sum(cents)::BIGINT AS cents FROM s GROUP BY 1")
def usage_by_first_day(spark, sf):
    s = events(spark, sf).groupBy("user_id").agg(F.min("day").alias("day"), F.count("*").alias("n"), F.sum("cents").alias("cents"))
    return s.groupBy("day").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"), F.sum("cents").alias("cents"))


@register("carry_window", f"""WITH {LEDGER}, r AS (SELECT session AS w, us, seq, tokens, CASE model WHEN 'm0' THEN 3 WHEN 'm1' THEN 15 ELSE 1 END AS rate FROM led WHERE kind IS NULL AND tokens > 0 AND model LIKE 'm_'), c AS (SELECT session AS w, us FROM led WHERE kind = 'compaction'),
t AS (SELECT session AS w, us, seq FROM led WHERE kind = 'output_style'), rs AS (SELECT r.*, (SELECT count(*) FROM c WHERE c.w = r.w AND c.us <= r.us) AS seg FROM r), ts AS (SELECT t.*, (SELECT count(*) FROM c WHERE c.w = t.w AND c.us <= t.us) AS seg FROM t),
rc AS (SELECT *, greatest(0, least(tokens, 900 - coalesce(sum(tokens) OVER (PARTITION BY w, seg ORDER BY us, tokens, rate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS adds FROM rs)
SELECT ts.seq AS turn_id, ts.w AS "window", ts.seg AS segment, coalesce(sum(adds), 0)::BIGINT AS carry_tokens, coalesce(sum(adds * rate), 0)::BIGINT AS carry_cost FROM ts LEFT JOIN rc ON rc.w = ts.w AND rc.seg = ts.seg AND rc.us < ts.us GROUP BY 1, 2, 3""")
def carry_window(spark, sf):
    """Rows, turns and resets as separate sources; the ceiling takes the crossing row in part."""
    led = ledger(spark, sf)
    rows = led.filter("kind IS NULL AND tokens > 0").join(F.broadcast(rates(spark)), "model").select(F.col("session").alias("window"), "us", "tokens", "rate")
    turns = led.filter("kind = 'output_style'").select(F.col("session").alias("window"), "us", F.col("seq").alias("turn_id"))
    return L.carry(rows, turns, led.filter("kind = 'compaction'").select(F.col("session").alias("window"), "us"), 900)


_ROUND = ("user_id AS session", "event_id AS i", "CASE WHEN event_type = 'click' THEN k % 5 END AS loop", "k AS t_in", "cents % 40 AS t_out", "cents % 500 AS c_read", "k % 60 AS c_write")


@register("collapse_saving", f"""WITH {EVENTS}, r AS (SELECT {", ".join(_ROUND)} FROM e), g AS (SELECT *, loop IS NOT NULL AND row_number() OVER (PARTITION BY session, loop ORDER BY i) > 1 AS gone FROM r),
l AS (SELECT *, coalesce(sum(CASE WHEN gone THEN c_write ELSE 0 END) OVER (PARTITION BY session ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lost FROM g),
s AS (SELECT session, sum(t_in * 10 + t_out * 50 + c_read + c_write * 12)::BIGINT AS baseline, coalesce(sum(t_in * 10 + t_out * 50 + greatest(0, c_read - lost) + c_write * 12) FILTER (NOT gone), 0)::BIGINT AS kept FROM l GROUP BY 1)
SELECT *, CASE WHEN baseline > 0 THEN round(greatest(0, (baseline - kept) / baseline), 6) ELSE 0 END AS fraction FROM s""")
def collapse_saving(spark, sf):
    return L.collapse_saving(events(spark, sf).selectExpr(*_ROUND), (10, 50, 1, 12))


# Joins of sessions

_TRACE = "SELECT c_custkey AS session, c_mktsegment AS host, c_acctbal FROM customer"


@register("proof_rows", f"""WITH {LEDGER}, b AS (SELECT seq, session, tool, tokens, model FROM led WHERE kind IS NULL), lg AS (SELECT session, sum(p_cost)::BIGINT AS ledger_cost FROM prd GROUP BY 1),
lv AS (SELECT session, tool, sum(calls)::BIGINT AS live_calls, arg_max(model, struct_pack(u := us, s := seq)) FILTER (model <> '') AS live_model FROM led WHERE kind = 'output_style' GROUP BY 1, 2)
SELECT b.seq, b.tool, coalesce(ledger_cost, 0) AS ledger_cost, coalesce(live_calls, 0) AS live_calls, coalesce(c_mktsegment, 'unknown') AS host, greatest(b.tokens, 0) * coalesce(r1.rate, r2.rate, 0) AS cost
FROM b LEFT JOIN lg USING (session) LEFT JOIN lv ON lv.session = b.session AND lv.tool = b.tool LEFT JOIN customer ON c_custkey = b.session LEFT JOIN rate r1 ON r1.model = b.model LEFT JOIN rate r2 ON r2.model = lv.live_model""")
def proof_rows(spark, sf):
    """Budget rows with the session's ledger, the live events of (session, tool) and the trace of the run; priced by their own model, else the live one."""
    led, price = ledger(spark, sf), rates(spark)
    b = led.filter("kind IS NULL").select("seq", "session", "tool", "tokens", "model")
    lg = L.priced(led, price).groupBy("session").agg(F.sum("p_cost").alias("ledger_cost"))
    lv = led.filter("kind = 'output_style'").groupBy("session", "tool").agg(F.sum("calls").alias("live_calls"), F.max_by("model", F.when(F.col("model") != "", F.struct("us", "seq"))).alias("live_model"))
    tr = table(spark, sf, "customer").select(F.col("c_custkey").alias("session"), F.col("c_mktsegment").alias("host"))
    j = b.join(lg, "session", "left").join(lv, ["session", "tool"], "left").join(tr, "session", "left")
    j = j.join(F.broadcast(price.select("model", F.col("rate").alias("r1"))), "model", "left").join(F.broadcast(price.select(F.col("model").alias("live_model"), F.col("rate").alias("r2"))), "live_model", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return j.select("seq", "tool", zero("ledger_cost"), zero("live_calls"), F.coalesce("host", F.lit("unknown")).alias("host"), (F.greatest("tokens", F.lit(0)) * F.coalesce("r1", "r2", F.lit(0))).alias("cost"))


@register("coverage_gaps", f"WITH {EVENTS} SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT user_id FROM e) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def coverage_gaps(spark, sf):
    """Traces of one host with neither live events nor budget rows."""
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return c.join(events(spark, sf).select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_anti").join(table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@register("host_import_stats", """WITH a AS (SELECT c_nationkey AS host, count(*) AS sessions FROM customer WHERE c_nationkey < 20 GROUP BY 1), b AS (SELECT s_nationkey AS host, max(s_suppkey) AS last_import FROM supplier WHERE s_nationkey > 5 GROUP BY 1)
SELECT coalesce(a.host, b.host) AS host, coalesce(sessions, 0) AS sessions, last_import FROM a FULL JOIN b ON a.host = b.host""")
def host_import_stats(spark, sf):
    a = table(spark, sf, "customer").filter("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("host")).agg(F.count("*").alias("sessions"))
    b = table(spark, sf, "supplier").filter("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("host")).agg(F.max("s_suppkey").alias("last_import"))
    return a.join(b, "host", "full").select("host", F.coalesce("sessions", F.lit(0)).alias("sessions"), "last_import")


@register("session_union", f"""WITH {EVENTS}, l AS (SELECT user_id AS id, 'live' AS origin, max(us) FILTER (event_type = 'signup') AS ended, max(us) AS updated, min(us) AS started FROM e GROUP BY 1),
i AS (SELECT o_custkey AS id, 'imported' AS origin, epoch_us(max(o_orderdate) FILTER (o_orderstatus = 'F')) AS ended, epoch_us(max(o_orderdate)) AS updated, epoch_us(min(o_orderdate)) AS started FROM orders WHERE o_custkey NOT IN (SELECT id FROM l) GROUP BY 1)
SELECT id, origin, coalesce(ended, updated, started) AS seen FROM (SELECT * FROM l UNION ALL SELECT * FROM i) ORDER BY seen DESC, id LIMIT 500""")
def session_union(spark, sf):
    """Live sessions first; imported ones only if they are not live. Latest by end, else update, else start."""
    l = events(spark, sf).groupBy(F.col("user_id").alias("id")).agg(F.max(F.when(F.col("event_type") == "signup", F.col("us"))).alias("ended"), F.max("us").alias("updated"), F.min("us").alias("started"))
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    i = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.when(F.col("o_orderstatus") == "F", at)).alias("ended"), F.max(at).alias("updated"), F.min(at).alias("started"))
    both = l.withColumn("origin", F.lit("live")).unionByName(i.join(l, "id", "left_anti").withColumn("origin", F.lit("imported")))
    return both.select("id", "origin", F.coalesce("ended", "updated", "started").alias("seen")).orderBy(F.desc("seen"), "id").limit(500)


@register("model_alias_join", """WITH m AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN 'vendor/big-4.5-20250101' WHEN 1 THEN 'big-4-5-latest' WHEN 2 THEN 'small-2' WHEN 3 THEN 'small-2-preview' WHEN 4 THEN 'small-2-mini-x' ELSE 'nothing' END AS model FROM part)
SELECT model, CASE model WHEN 'nothing' THEN NULL WHEN 'vendor/big-4.5-20250101' THEN 'big-4-5' WHEN 'big-4-5-latest' THEN 'big-4-5' WHEN 'small-2-mini-x' THEN 'small-2-mini' ELSE 'small-2' END AS card, CASE model WHEN 'nothing' THEN 0 WHEN 'vendor/big-4.5-20250101' THEN 15 WHEN 'big-4-5-latest' THEN 15 WHEN 'small-2-mini-x' THEN 1 ELSE 3 END AS rate FROM m""")
def model_alias_join(spark, sf):
    """Names resolve once each: vendor, date, tag words and dots go; then the exact card, else the longest card that begins the name."""
    cards = spark.createDataFrame([("big-4-5", 15), ("small-2", 3), ("small-2-mini", 1)], "card string, rate long")
    name = "CASE p_partkey % 6 WHEN 0 THEN 'vendor/big-4.5-20250101' WHEN 1 THEN 'big-4-5-latest' WHEN 2 THEN 'small-2' WHEN 3 THEN 'small-2-preview' WHEN 4 THEN 'small-2-mini-x' ELSE 'nothing' END AS model"
    m = table(spark, sf, "part").selectExpr(name).distinct()
    plain = F.replace(F.regexp_replace(F.regexp_replace("model", "^.*/", ""), r"(-\d{8}|-latest|-preview)+$", ""), F.lit("."), F.lit("-"))
    m = m.withColumn("plain", plain)
    hit = m.join(F.broadcast(cards), F.col("plain").startswith(F.col("card"))).groupBy("model").agg(F.max_by(F.struct("card", "rate"), F.length("card")).alias("x"))
    return m.join(hit, "model", "left").select("model", "x.card", F.coalesce("x.rate", F.lit(0)).alias("rate"))


@register("pending_credit", f"""WITH {EVENTS}, p AS (SELECT user_id, k, min(struct_pack(u := us, i := event_id)) AS at FROM e WHERE event_type = 'click' GROUP BY 1, 2),
c AS (SELECT p.user_id, p.k, p.at, min(struct_pack(u := us, i := event_id)) AS used FROM p LEFT JOIN e ON e.user_id = p.user_id AND e.k = p.k AND event_type = 'purchase' AND struct_pack(u := us, i := event_id) > p.at GROUP BY 1, 2, 3),
t AS (SELECT c.user_id, c.k, c.at, c.used, struct_pack(u := us, i := event_id) AS tick, row_number() OVER (PARTITION BY c.user_id, c.k ORDER BY us, event_id) AS age FROM c JOIN e ON e.user_id = c.user_id AND event_type = 'view' AND struct_pack(u := us, i := event_id) > c.at)
SELECT user_id, k, tick.i AS credited_at FROM t WHERE age = 3 AND (used IS NULL OR tick < used)""")
def pending_credit(spark, sf):
    """A hint (click) waits for its read (purchase of the same k); at the third tick (view) without it, it is credited once.

    Ticks of a user are numbered once, so the third tick after a hint is a position and not a range join of hints with ticks.
    """
    at = F.struct("us", "event_id")
    e = events(spark, sf).select("user_id", "k", "event_type", at.alias("at"))
    hint = e.filter("event_type = 'click'").groupBy("user_id", "k").agg(F.min("at").alias("hint"))
    by = Window.partitionBy("user_id").orderBy("at")
    marked = e.filter("event_type = 'view'").select("user_id", "at", F.lit(None).cast("long").alias("k")).union(hint.select("user_id", F.col("hint").alias("at"), "k"))
    n = marked.withColumn("n", F.count_if(F.col("k").isNull()).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    due = n.filter("k IS NOT NULL").select("user_id", "k", F.col("at").alias("hint"), (F.col("n") + 3).alias("n")).join(n.filter("k IS NULL").select("user_id", "n", F.col("at").alias("tick")), ["user_id", "n"])
    used = e.filter("event_type = 'purchase'").join(hint, ["user_id", "k"]).filter("at > hint").groupBy("user_id", "k").agg(F.min("at").alias("used"))
    return due.join(used, ["user_id", "k"], "left").filter("used IS NULL OR tick < used").select("user_id", "k", F.col("tick.event_id").alias("credited_at"))
