"""Dashboards, usage reports, gates and audits over events, orders and line items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserix.operators import credits as C
from tesserix.plans.base import EVENTS, events
from tesserix.plans.registry import register
from tesserix.sources import table


def _sum(test, value=1):
    return F.sum(F.when(test, value).otherwise(0))


_DURATION = "CASE WHEN k < 10 THEN '<10' WHEN k < 60 THEN '10-60' WHEN k < 300 THEN '60-300' WHEN k < 1800 THEN '300-1800' ELSE '>1800' END"
_MILLIS = "CASE WHEN cents < 100 THEN '<100' WHEN cents < 500 THEN '100-500' WHEN cents < 2000 THEN '500-2000' WHEN cents < 10000 THEN '2000-10000' ELSE '>10000' END"
_EDIT = "CASE WHEN k - 20 <= 0 THEN 'none' WHEN k - 20 < 25 THEN 'small' WHEN k - 20 < 60 THEN 'medium' ELSE 'large' END"


@register("duration_buckets", f"WITH {EVENTS} SELECT {_DURATION} AS seconds, {_MILLIS} AS millis, {_EDIT} AS edit, count(*) AS n FROM e GROUP BY 1, 2, 3")
def duration_buckets(spark, sf):
    """Seconds, milliseconds and edit distance (in hundredths): five, five and four half-open classes."""

    def cut(col, bounds, names):
        out = F.when(col < bounds[0], names[0])
        for b, name in zip(bounds[1:], names[1:]):
            out = out.when(col < b, name)
        return out.otherwise(names[-1])

    k, c = F.col("k"), F.col("cents")
    seconds = cut(k, (10, 60, 300, 1800), ("<10", "10-60", "60-300", "300-1800", ">1800"))
    millis = cut(c, (100, 500, 2000, 10000), ("<100", "100-500", "500-2000", "2000-10000", ">10000"))
    edit = F.when(k - 20 <= 0, "none").otherwise(cut(k - 20, (25, 60), ("small", "medium", "large")))
    return events(spark, sf).groupBy(seconds.alias("seconds"), millis.alias("millis"), edit.alias("edit")).agg(F.count("*").alias("n"))


_KINDS = ("prompt", "cached", "cache_create", "result", "thinking", "tool_call", "tool_charge", "user_string")
_TYPED = "[" + ", ".join(f"{{'kind': '{kind}', 'tokens': (k * {i + 3} + cents) % {40 + 7 * i} - 10}}" for i, kind in enumerate(_KINDS)) + "]"
_TYPES = f"{EVENTS}, x AS (SELECT event_id, user_id, day, event_type, us, cents, k, unnest({_TYPED}) AS s FROM e), t AS (SELECT event_id, user_id, day, event_type, us, s.kind AS kind, s.tokens AS tokens, CASE k % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'bash' ELSE 'grep' END AS tool, 'h' || (user_id % 4) AS host, 'm' || (k % 3) AS model FROM x WHERE s.tokens > 0)"


def typed(spark, sf):
    """One trace row becomes up to eight typed rows; those without tokens go."""
    parts = [F.struct(F.lit(kind).alias("kind"), ((F.col("k") * (i + 3) + F.col("cents")) % (40 + 7 * i) - 10).alias("tokens")) for i, kind in enumerate(_KINDS)]
    tool = F.when(F.col("k") % 3 == 0, "read").when(F.col("k") % 3 == 1, "bash").otherwise("grep")
    x = events(spark, sf).select("event_id", "user_id", "day", "event_type", "us", tool.alias("tool"), F.concat(F.lit("h"), F.col("user_id") % 4).alias("host"), F.concat(F.lit("m"), F.col("k") % 3).alias("model"), F.inline(F.array(*parts)))
    return x.filter("tokens > 0")


@register("explode_eight_kinds", f"WITH {_TYPES} SELECT kind, tool, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM t GROUP BY 1, 2")
def explode_eight_kinds(spark, sf):
    return typed(spark, sf).groupBy("kind", "tool").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@register("grouped_seven_keys", f"""WITH {_TYPES} SELECT kind, tool, host, model, event_type, day, user_id % 3 AS project, sum(tokens)::BIGINT AS tokens, min(us) AS first_seen, max(us) AS last_seen, count(DISTINCT event_id) AS traces FROM t GROUP BY ALL""")
def grouped_seven_keys(spark, sf):
    g = typed(spark, sf).groupBy("kind", "tool", "host", "model", "event_type", "day", (F.col("user_id") % 3).alias("project"))
    return g.agg(F.sum("tokens").alias("tokens"), F.min("us").alias("first_seen"), F.max("us").alias("last_seen"), F.countDistinct("event_id").alias("traces"))


@register("kpi_projection", f"""WITH {_TYPES}, a AS (SELECT sum(tokens)::BIGINT AS tokens, count(DISTINCT tool) AS tools, count(DISTINCT event_id) AS traces, greatest(1, max(day)::DATE - min(day)::DATE + 1) AS days, coalesce(sum(tokens) FILTER (kind = 'tool_call'), 0)::BIGINT AS call_tokens FROM t),
d AS (SELECT tool FROM t GROUP BY 1 ORDER BY sum(tokens) DESC, tool LIMIT 1) SELECT tokens, tools, traces, days::BIGINT AS days, call_tokens, round(tokens * 30.0 / days, 4) AS monthly, tool AS top_tool FROM a, d""")
def kpi_projection(spark, sf):
    t = typed(spark, sf)
    per = t.groupBy("tool").agg(F.sum("tokens").alias("s"))
    top = per.agg(F.min_by("tool", F.struct((-F.col("s")).alias("s"), "tool")).alias("top_tool"))
    a = t.agg(F.sum("tokens").alias("tokens"), F.countDistinct("tool").alias("tools"), F.countDistinct("event_id").alias("traces"), F.greatest(F.lit(1), F.date_diff(F.max(F.col("day").cast("date")), F.min(F.col("day").cast("date"))) + 1).cast("long").alias("days"), _sum(F.col("kind") == "tool_call", F.col("tokens")).alias("call_tokens"))
    return a.join(F.broadcast(top)).select("tokens", "tools", "traces", "days", "call_tokens", F.round(F.col("tokens") * F.lit(30.0) / F.col("days"), 4).alias("monthly"), "top_tool")


@register("provider_tokens", """SELECT c_mktsegment AS provider, coalesce(sum(CASE WHEN o_orderstatus <> 'P' THEN CAST(round(o_totalprice) AS BIGINT) END), 0)::BIGINT AS tokens, coalesce(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END), 0)::BIGINT AS cached
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def provider_tokens(spark, sf):
    j = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy(F.col("c_mktsegment").alias("provider")).agg(F.coalesce(F.sum(F.when(F.col("o_orderstatus") != "P", F.round("o_totalprice").cast("long"))), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey"))), F.lit(0)).alias("cached"))


_SUMMARY = {
    "events": "count(*)", "sessions": "count(DISTINCT user_id)", "first_us": "min(us)", "last_us": "max(us)", "days": "count(DISTINCT day)", "kinds": "count(DISTINCT event_type)",
    "views": "count(*) FILTER (event_type = 'view')", "clicks": "count(*) FILTER (event_type = 'click')", "errors": "count(*) FILTER (event_type = 'error')", "signups": "count(*) FILTER (event_type = 'signup')",
    "low": "count(*) FILTER (k < 25)", "mid": "count(*) FILTER (k >= 25 AND k < 50)", "high": "count(*) FILTER (k >= 50 AND k < 75)", "top": "count(*) FILTER (k >= 75)",
    "hits": "count(*) FILTER (cents % 2 = 0)", "misses": "count(*) FILTER (cents % 2 = 1)",
}


@register("telemetry_summary", f"WITH {EVENTS} SELECT {', '.join(f'{v} AS {k}' for k, v in _SUMMARY.items())}, round(count(*) FILTER (cents % 2 = 0) / count(*), 6) AS hit_rate FROM e")
def telemetry_summary(spark, sf):
    """Seventeen measures in one pass."""
    t, k, c = F.col("event_type"), F.col("k"), F.col("cents")
    return events(spark, sf).agg(
        F.count("*").alias("events"), F.countDistinct("user_id").alias("sessions"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.countDistinct("day").alias("days"), F.countDistinct("event_type").alias("kinds"),
        *[F.count_if(t == x).alias(x + "s") for x in ("view", "click", "error", "signup")],
        F.count_if(k < 25).alias("low"), F.count_if((k >= 25) & (k < 50)).alias("mid"), F.count_if((k >= 50) & (k < 75)).alias("high"), F.count_if(k >= 75).alias("top"),
        F.count_if(c % 2 == 0).alias("hits"), F.count_if(c % 2 == 1).alias("misses"), F.round(F.count_if(c % 2 == 0) / F.count("*"), 6).alias("hit_rate"),
    )


@register("dashboard_hosts", f"""WITH {_TYPES} SELECT host, model, count(DISTINCT user_id) AS sessions, sum(tokens)::BIGINT AS tokens, round(sum(tokens) / count(DISTINCT user_id), 4) AS per_session, round(100.0 * coalesce(sum(tokens) FILTER (kind = 'cached'), 0) / sum(tokens), 4) AS cache_pct
FROM t GROUP BY 1, 2 ORDER BY tokens DESC, host, model LIMIT 30""")
def dashboard_hosts(spark, sf):
    g = typed(spark, sf).groupBy("host", "model").agg(F.countDistinct("user_id").alias("sessions"), F.sum("tokens").alias("tokens"), _sum(F.col("kind") == "cached", F.col("tokens")).alias("c"))
    return g.select("host", "model", "sessions", "tokens", F.round(F.col("tokens") / F.col("sessions"), 4).alias("per_session"), F.round(F.lit(100.0) * F.col("c") / F.col("tokens"), 4).alias("cache_pct")).orderBy(F.desc("tokens"), "host", "model").limit(30)


@register("dashboard_host_model", f"""WITH {_TYPES}, s AS (SELECT user_id, host, arg_max(model, struct_pack(u := us, i := event_id)) AS own FROM t GROUP BY 1, 2)
SELECT t.host, t.model, count(DISTINCT t.user_id) AS sessions, sum(tokens)::BIGINT AS tokens, coalesce(sum(tokens) FILTER (kind IN ('prompt', 'tool_call') AND model = own), 0)::BIGINT AS attributed FROM t JOIN s USING (user_id, host) GROUP BY 1, 2""")
def dashboard_host_model(spark, sf):
    """A session counts once a pair; prompt and tool tokens only on the model that the session is attributed to."""
    t = typed(spark, sf)
    s = t.groupBy("user_id", "host").agg(F.max_by("model", F.struct("us", "event_id")).alias("own"))
    own = F.col("kind").isin("prompt", "tool_call") & (F.col("model") == F.col("own"))
    return t.join(s, ["user_id", "host"]).groupBy("host", "model").agg(F.countDistinct("user_id").alias("sessions"), F.sum("tokens").alias("tokens"), _sum(own, F.col("tokens")).alias("attributed"))


@register("dashboard_days", f"""WITH {EVENTS} SELECT strftime(make_timestamp(us) - INTERVAL 5 HOUR, '%Y-%m-%d') AS local_day, count(DISTINCT user_id) AS sessions, sum(cents)::BIGINT AS cents, sum(k)::BIGINT AS tokens FROM e GROUP BY 1""")
def dashboard_days(spark, sf):
    """Days of a place five hours behind UTC."""
    local = F.date_format(F.timestamp_micros(F.col("us") - 5 * 3_600_000_000), "yyyy-MM-dd")
    return events(spark, sf).groupBy(local.alias("local_day")).agg(F.countDistinct("user_id").alias("sessions"), F.sum("cents").alias("cents"), F.sum("k").alias("tokens"))


@register("usage_per_model", f"""WITH {_TYPES}, u AS (SELECT user_id, model, tokens FROM t WHERE kind IN ('prompt', 'result') AND model <> 'm0'), o AS (SELECT user_id, CASE WHEN count(DISTINCT model) = 1 THEN min(model) END AS single FROM u GROUP BY 1)
SELECT model, count(*) AS n, sum(tokens)::BIGINT AS tokens, count(DISTINCT user_id) FILTER (single IS NOT NULL) AS single_sessions FROM u JOIN o USING (user_id) GROUP BY 1""")
def usage_per_model(spark, sf):
    """Model entries only, placeholder models left out; sessions of one model resolve to it."""
    u = typed(spark, sf).filter("kind IN ('prompt', 'result') AND model <> 'm0'")
    o = u.groupBy("user_id").agg(F.when(F.countDistinct("model") == 1, F.min("model")).alias("single"))
    return u.join(o, "user_id").groupBy("model").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.countDistinct(F.when(F.col("single").isNotNull(), F.col("user_id"))).alias("single_sessions"))


@register("live_index", f"WITH {EVENTS} SELECT user_id, count(*) AS n, sum(k)::BIGINT AS tokens, coalesce(sum(cents) FILTER (event_type = 'purchase'), 0)::BIGINT AS cents, max(us) AS last_us FROM e GROUP BY 1")
def live_index(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("k").alias("tokens"), _sum(F.col("event_type") == "purchase", F.col("cents")).alias("cents"), F.max("us").alias("last_us"))


@register("cost_by_token_class", f"""WITH {_TYPES} SELECT user_id, sum(CASE kind WHEN 'prompt' THEN tokens * r WHEN 'user_string' THEN tokens * r ELSE 0 END)::BIGINT AS input, sum(CASE kind WHEN 'cached' THEN tokens * r // 10 ELSE 0 END)::BIGINT AS cache_read,
sum(CASE kind WHEN 'cache_create' THEN tokens * r * 5 // 4 ELSE 0 END)::BIGINT AS cache_write, sum(CASE WHEN kind IN ('result', 'thinking') THEN tokens * r * 5 ELSE 0 END)::BIGINT AS output FROM (SELECT *, CASE model WHEN 'm0' THEN 30 WHEN 'm1' THEN 150 ELSE 8 END AS r FROM t) GROUP BY 1""")
def cost_by_token_class(spark, sf):
    """Each call priced at its model's rate, summed by class: reads at a tenth, writes at five quarters, output at five times."""
    r = F.when(F.col("model") == "m0", 30).when(F.col("model") == "m1", 150).otherwise(8)
    t = F.col("tokens") * r
    kind = F.col("kind")
    return typed(spark, sf).groupBy("user_id").agg(
        _sum(kind.isin("prompt", "user_string"), t).alias("input"), _sum(kind == "cached", F.floor(t / 10)).alias("cache_read"), _sum(kind == "cache_create", F.floor(t * 5 / 4)).alias("cache_write"), _sum(kind.isin("result", "thinking"), t * 5).alias("output"),
    )


@register("lever_attribution", f"""WITH {EVENTS}, x AS (SELECT user_id, unnest(['read', 'compact_tool_output:' || event_type, 'cache']) AS lever, unnest([k, cents % 100, cents % 7]) AS saved FROM e)
SELECT CASE WHEN starts_with(lever, 'compact_tool_output:') THEN 'compact' ELSE lever END AS lever, CASE WHEN starts_with(lever, 'compact_tool_output:') THEN split_part(lever, ':', 2) END AS method, sum(saved)::BIGINT AS saved, count(DISTINCT user_id) AS runs FROM x WHERE saved > 0 GROUP BY 1, 2""")
def lever_attribution(spark, sf):
    """A map of lever to saving a row, exploded; the method after the colon is split off."""
    m = F.create_map(F.lit("read"), F.col("k"), F.concat(F.lit("compact_tool_output:"), F.col("event_type")), F.col("cents") % 100, F.lit("cache"), F.col("cents") % 7)
    x = events(spark, sf).select("user_id", F.explode(m).alias("lever", "saved")).filter("saved > 0")
    compact = F.col("lever").startswith("compact_tool_output:")
    return x.groupBy(F.when(compact, "compact").otherwise(F.col("lever")).alias("lever"), F.when(compact, F.element_at(F.split("lever", ":"), 2)).alias("method")).agg(F.sum("saved").alias("saved"), F.countDistinct("user_id").alias("runs"))


@register("lever_prefix_match", f"""WITH {EVENTS}, x AS (SELECT user_id, unnest(['read', 'read_cached', 'reader', 'search']) AS lever, unnest([k, cents % 9, 1, cents % 5]) AS v FROM e)
SELECT user_id, coalesce(sum(v) FILTER (lever = 'read'), 0)::BIGINT AS exact, coalesce(sum(v) FILTER (lever = 'read' OR starts_with(lever, 'read_')), 0)::BIGINT AS family FROM x GROUP BY 1""")
def lever_prefix_match(spark, sf):
    m = F.create_map(F.lit("read"), F.col("k"), F.lit("read_cached"), F.col("cents") % 9, F.lit("reader"), F.lit(1).cast("long"), F.lit("search"), F.col("cents") % 5)
    x = events(spark, sf).select("user_id", F.explode(m).alias("lever", "v"))
    return x.groupBy("user_id").agg(_sum(F.col("lever") == "read", F.col("v")).alias("exact"), _sum((F.col("lever") == "read") | F.col("lever").startswith("read_"), F.col("v")).alias("family"))


# Gates

_ARMS = "SELECT l_orderkey AS task, l_linenumber % 2 AS arm, CAST(l_quantity AS BIGINT) >= 20 AS ok, l_linenumber // 2 AS rep, CAST(l_quantity AS BIGINT) * CASE WHEN l_linenumber % 2 = 1 THEN 9 ELSE 10 END AS cost FROM lineitem"


def _arms(spark, sf):
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task"), (n % 2).alias("arm"), (q >= 20).alias("ok"), F.floor(n / 2).alias("rep"), (q * F.when(n % 2 == 1, 9).otherwise(10)).alias("cost"))


def _wilson(k: str, n: str) -> tuple[str, str]:
    p, z = f"({k} / {n})", "1.96"
    mid, half = f"({p} + {z} * {z} / (2 * {n}))", f"({z} * sqrt(({p} * (1 - {p}) + {z} * {z} / (4 * {n})) / {n}))"
    return tuple(f"(({mid} {s} {half}) / (1 + {z} * {z} / {n}))" for s in "-+")


_B, _K = _wilson("bk", "bn"), _wilson("ck", "cn")


@register("gate_arms", f"""WITH r AS ({_ARMS}), g AS (SELECT count(*) FILTER (arm = 0) AS bn, count(*) FILTER (arm = 1) AS cn, count(*) FILTER (arm = 0 AND ok) AS bk, count(*) FILTER (arm = 1 AND ok) AS ck, sum(cost) FILTER (arm = 0)::BIGINT AS bc, sum(cost) FILTER (arm = 1)::BIGINT AS cc FROM r),
w AS (SELECT *, {_K[0]} - {_B[1]} AS lo, {_K[1]} - {_B[0]} AS hi FROM g)
SELECT round(lo, 6) AS delta_lower, round(hi, 6) AS delta_upper, round(ck / cn - bk / bn, 6) AS delta, cc - bc AS cost_delta, array_to_string(list_filter([CASE WHEN lo < -0.05 THEN 'quality' END, CASE WHEN cc >= bc THEN 'cost' END], lambda x: x IS NOT NULL), ',') AS reasons, lo >= -0.05 AND cc < bc AS passed FROM w""")
def gate_arms(spark, sf):
    """The candidate passes if the lower bound of its rate less the upper bound of the baseline's is within the margin, and it costs less."""
    a, ok, cost = F.col("arm"), F.col("ok"), F.col("cost")
    g = _arms(spark, sf).agg(_sum(a == 0).alias("bn"), _sum(a == 1).alias("cn"), _sum((a == 0) & ok).alias("bk"), _sum((a == 1) & ok).alias("ck"), _sum(a == 0, cost).alias("bc"), _sum(a == 1, cost).alias("cc"))
    (bl, bu), (cl, cu) = C.wilson(F.col("bk"), F.col("bn")), C.wilson(F.col("ck"), F.col("cn"))
    w = g.withColumns({"lo": cl - bu, "hi": cu - bl})
    worse, dear = F.col("lo") < -0.05, F.col("cc") >= F.col("bc")
    return w.select(F.round("lo", 6).alias("delta_lower"), F.round("hi", 6).alias("delta_upper"), F.round(F.col("ck") / F.col("cn") - F.col("bk") / F.col("bn"), 6).alias("delta"), (F.col("cc") - F.col("bc")).alias("cost_delta"), F.array_join(F.array_compact(F.array(F.when(worse, "quality"), F.when(dear, "cost"))), ",").alias("reasons"), (~worse & ~dear).alias("passed"))


@register("gate_paired", f"""WITH r AS ({_ARMS}), a AS (SELECT task, rep, arm, bool_and(ok) AS ok, sum(cost)::BIGINT AS cost FROM r GROUP BY 1, 2, 3), p AS (SELECT b.ok AS b_ok, c.ok AS c_ok, b.cost AS b_cost, c.cost AS c_cost FROM a b JOIN a c ON b.task = c.task AND b.rep = c.rep AND b.arm = 0 AND c.arm = 1)
SELECT count(*) AS pairs, count(*) FILTER (c_ok AND NOT b_ok) AS better, count(*) FILTER (b_ok AND NOT c_ok) AS worse, round(avg(c_ok::INT - b_ok::INT), 6) AS delta, round(avg(c_ok::INT - b_ok::INT) - 1.96 * stddev_samp(c_ok::INT - b_ok::INT) / sqrt(count(*)), 6) AS lower,
sum(c_cost - b_cost)::BIGINT AS cost_delta, avg(c_ok::INT - b_ok::INT) - 1.96 * stddev_samp(c_ok::INT - b_ok::INT) / sqrt(count(*)) >= -0.05 AND sum(c_cost) < sum(b_cost) AS passed FROM p""")
def gate_paired(spark, sf):
    """Arms joined by (task, rep): the paired difference keeps within the margin and cost falls."""
    a = _arms(spark, sf).groupBy("task", "rep", "arm").agg(F.bool_and("ok").cast("int").alias("ok"), F.sum("cost").alias("cost"))
    b, c = a.filter("arm = 0").select("task", "rep", F.col("ok").alias("b"), F.col("cost").alias("bc")), a.filter("arm = 1").select("task", "rep", F.col("ok").alias("c"), F.col("cost").alias("cc"))
    d = F.col("c") - F.col("b")
    lower = F.avg(d) - 1.96 * F.stddev_samp(d) / F.sqrt(F.count("*"))
    return b.join(c, ["task", "rep"]).agg(F.count("*").alias("pairs"), F.count_if(d == 1).alias("better"), F.count_if(d == -1).alias("worse"), F.round(F.avg(d), 6).alias("delta"), F.round(lower, 6).alias("lower"), F.sum(F.col("cc") - F.col("bc")).alias("cost_delta"), ((lower >= -0.05) & (F.sum("cc") < F.sum("bc"))).alias("passed"))


@register("weekly_report", f"""WITH {EVENTS}, m AS (SELECT max(day)::DATE AS d FROM e), c AS (SELECT event_type AS domain, CASE WHEN day::DATE > d - 7 THEN 'now' WHEN day::DATE > d - 14 THEN 'before' END AS period, [k >= 20, cents % 3 <> 0, cents > 100] AS checks FROM e, m),
r AS (SELECT domain, count(*) FILTER (period = 'now') AS n, count(*) FILTER (period = 'now' AND list_bool_and(checks)) AS passed, count(*) FILTER (period = 'before') AS n0, count(*) FILTER (period = 'before' AND list_bool_and(checks)) AS passed0, count(*) FILTER (period = 'now' AND NOT checks[1]) AS failed_first FROM c GROUP BY 1)
SELECT domain, n, failed_first, CASE WHEN n > 0 THEN round(passed / n, 6) END AS pass_rate, CASE WHEN n > 0 AND n0 > 0 AND passed0 > 0 THEN round((passed / n - passed0 / n0) * 100 / (passed0 / n0), 4) END AS drift_pct FROM r""")
def weekly_report(spark, sf):
    """A run passes if all its checks do; rates a domain of this week and their drift against the week before, null without a base."""
    e = events(spark, sf)
    day, d = F.col("day").cast("date"), F.col("d")
    now, before = day > F.date_sub(d, 7), (day <= F.date_sub(d, 7)) & (day > F.date_sub(d, 14))
    checks = F.array(F.col("k") >= 20, F.col("cents") % 3 != 0, F.col("cents") > 100)
    ok = F.forall(checks, lambda x: x)
    r = e.join(F.broadcast(e.agg(F.max("day").cast("date").alias("d")))).groupBy(F.col("event_type").alias("domain")).agg(
        F.count_if(now).alias("n"), F.count_if(now & ok).alias("p"), F.count_if(before).alias("n0"), F.count_if(before & ok).alias("p0"), F.count_if(now & ~checks[0]).alias("failed_first"))
    rate, base = F.col("p") / F.col("n"), F.col("p0") / F.col("n0")
    return r.select("domain", "n", "failed_first", F.when(F.col("n") > 0, F.round(rate, 6)).alias("pass_rate"), F.when((F.col("n") > 0) & (F.col("n0") > 0) & (F.col("p0") > 0), F.round((rate - base) * 100 / base, 4)).alias("drift_pct"))


@register("playbook_top", f"""WITH {EVENTS}, x AS (SELECT unnest(['pb' || (k % 17), 'pb' || (cents % 23)]) AS playbook, greatest(1, cents % 4) AS weight FROM e WHERE event_type IN ('click', 'view')) SELECT playbook, sum(weight)::BIGINT AS uses FROM x GROUP BY 1 ORDER BY uses DESC, playbook LIMIT 5""")
def playbook_top(spark, sf):
    ids = F.array(F.concat(F.lit("pb"), F.col("k") % 17), F.concat(F.lit("pb"), F.col("cents") % 23))
    x = events(spark, sf).filter("event_type IN ('click', 'view')").select(F.explode(ids).alias("playbook"), F.greatest(F.lit(1), F.col("cents") % 4).alias("weight"))
    return x.groupBy("playbook").agg(F.sum("weight").alias("uses")).orderBy(F.desc("uses"), "playbook").limit(5)


def _vote(now: str, before: str, good: str) -> str:
    return f"CASE WHEN {before} <= 0 OR {before} IS NULL OR {now} IS NULL THEN 0 WHEN ({now} - {before}) / {before} {'<' if good == 'down' else '>'} {'-0.05' if good == 'down' else '0.05'} THEN 1 WHEN ({now} - {before}) / {before} {'>' if good == 'down' else '<'} {'0.05' if good == 'down' else '-0.05'} THEN -1 ELSE 0 END"


_VOTES = f"{_vote('t1', 't0', 'down')} + {_vote('c1', 'c0', 'down')} + {_vote('l1', 'l0', 'up')}"


@register("impact_verdict", f"""WITH {EVENTS}, h AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM e),
w AS (SELECT user_id, avg(k) FILTER (i <= greatest(1, n // 2)) AS t0, avg(k) FILTER (i > greatest(1, n // 2)) AS t1, avg(cents) FILTER (i <= greatest(1, n // 2)) AS c0, avg(cents) FILTER (i > greatest(1, n // 2)) AS c1, avg(cents % 10) FILTER (i <= greatest(1, n // 2)) AS l0, avg(cents % 10) FILTER (i > greatest(1, n // 2)) AS l1 FROM h GROUP BY 1)
SELECT user_id, round((t1 - t0) * 100 / t0, 4) AS tokens_pct, round((c1 - c0) * 100 / c0, 4) AS cost_pct, round((l1 - l0) * 100 / l0, 4) AS leverage_pct, ({_VOTES})::BIGINT AS votes, CASE WHEN {_VOTES} > 0 THEN 'better' WHEN {_VOTES} < 0 THEN 'worse' ELSE 'flat' END AS verdict FROM w""")
def impact_verdict(spark, sf):
    """Earlier and later half of a session: three changes in per cent, a vote each beyond five per cent, and the sum's verdict."""
    by = Window.partitionBy("user_id")
    h = events(spark, sf).withColumn("i", F.row_number().over(by.orderBy("us", "event_id"))).withColumn("half", F.greatest(F.lit(1), F.floor(F.count("*").over(by) / 2)))
    early, late = F.col("i") <= F.col("half"), F.col("i") > F.col("half")
    measures = {"t": F.col("k"), "c": F.col("cents"), "l": F.col("cents") % 10}
    w = h.groupBy("user_id").agg(*[F.avg(F.when(x, v)).alias(f"{m}{i}") for m, v in measures.items() for i, x in enumerate((early, late))])

    def change(m):
        return F.when(F.col(m + "0") != 0, (F.col(m + "1") - F.col(m + "0")) / F.col(m + "0"))

    def vote(m, sign):
        r = sign * change(m)
        return F.when(r > 0.05, 1).when(r < -0.05, -1).otherwise(0)

    votes = (vote("t", -1) + vote("c", -1) + vote("l", 1)).cast("long")
    pct = lambda m: F.round((F.col(m + "1") - F.col(m + "0")) * 100 / F.col(m + "0"), 4)
    return w.select("user_id", pct("t").alias("tokens_pct"), pct("c").alias("cost_pct"), pct("l").alias("leverage_pct"), votes.alias("votes"), F.when(votes > 0, "better").when(votes < 0, "worse").otherwise("flat").alias("verdict"))


@register("reread_telemetry", f"""WITH {EVENTS}, r AS (SELECT user_id, 'p' || (k % 20) AS path, event_type AS kind, row_number() OVER (PARTITION BY user_id, k % 20 ORDER BY us, event_id) AS i FROM e), p AS (SELECT path, count(*) AS reads, count(*) FILTER (i > 1) AS rereads FROM r GROUP BY 1),
k AS (SELECT kind, count(*) FILTER (i > 1) AS rereads FROM r GROUP BY 1) SELECT 'path' AS by_what, path AS name, reads, rereads FROM p UNION ALL SELECT 'kind', kind, NULL, rereads FROM k""")
def reread_telemetry(spark, sf):
    path = F.concat(F.lit("p"), F.col("k") % 20)
    r = events(spark, sf).select("user_id", path.alias("path"), F.col("event_type").alias("kind"), F.row_number().over(Window.partitionBy("user_id", F.col("k") % 20).orderBy("us", "event_id")).alias("i"))
    p = r.groupBy("path").agg(F.count("*").alias("reads"), F.count_if(F.col("i") > 1).alias("rereads")).select(F.lit("path").alias("by_what"), F.col("path").alias("name"), "reads", "rereads")
    return p.union(r.groupBy("kind").agg(F.count_if(F.col("i") > 1).alias("rereads")).select(F.lit("kind"), "kind", F.lit(None).cast("long"), "rereads"))


@register("live_source_totals", f"""WITH {EVENTS}, s AS (SELECT event_type AS lever, 't' || (k % 9) AS tool, sum(k - 30)::BIGINT AS tokens, sum(cents)::BIGINT AS cost, count(*) AS n FROM e GROUP BY 1, 2) SELECT lever, tool, tokens, cost, n, tokens <= 0 AND cost > 0 AS cost_only FROM s ORDER BY cost DESC, lever, tool LIMIT 10""")
def live_source_totals(spark, sf):
    s = events(spark, sf).groupBy(F.col("event_type").alias("lever"), F.concat(F.lit("t"), F.col("k") % 9).alias("tool")).agg(F.sum(F.col("k") - 30).alias("tokens"), F.sum("cents").alias("cost"), F.count("*").alias("n"))
    return s.withColumn("cost_only", (F.col("tokens") <= 0) & (F.col("cost") > 0)).orderBy(F.desc("cost"), "lever", "tool").limit(10)


@register("proof_aggregates", f"""WITH {EVENTS}, p AS (SELECT user_id, 't' || (k % 4) AS tool, CASE k % 3 WHEN 0 THEN 'compact' WHEN 1 THEN 'read' ELSE 'search' END AS lever, cents FROM e)
SELECT tool, lever, sum(cents)::BIGINT AS saved, count(DISTINCT user_id) AS sessions, coalesce(sum(cents) FILTER (lever <> 'compact'), 0)::BIGINT AS headline FROM p GROUP BY GROUPING SETS ((tool, lever), (tool))""")
def proof_aggregates(spark, sf):
    """By tool and lever and by tool; compact rows count everywhere but in the headline."""
    lever = F.when(F.col("k") % 3 == 0, "compact").when(F.col("k") % 3 == 1, "read").otherwise("search")
    p = events(spark, sf).select("user_id", F.concat(F.lit("t"), F.col("k") % 4).alias("tool"), lever.alias("lever"), "cents", lever.alias("_l"))
    return p.groupingSets([["tool", "lever"], ["tool"]], "tool", "lever").agg(F.sum("cents").alias("saved"), F.countDistinct("user_id").alias("sessions"), _sum(F.col("_l") != "compact", F.col("cents")).alias("headline"))


@register("outcome_scores", f"""WITH {EVENTS}, x AS (SELECT user_id, unnest([k, k % 10]) AS a, unnest([cents % 100, NULL]) AS b, k % 40 AS extra FROM e) SELECT user_id, round(avg(a), 4) AS score, round(avg(b), 4) AS outcome, max(extra) / 100.0 > 0.3 AS extra_reads FROM x GROUP BY 1""")
def outcome_scores(spark, sf):
    lists = events(spark, sf).select("user_id", F.arrays_zip(F.array("k", F.col("k") % 10).alias("a"), F.array(F.col("cents") % 100, F.lit(None)).alias("b")).alias("z"), (F.col("k") % 40).alias("extra"))
    x = lists.select("user_id", "extra", F.inline("z"))
    return x.toDF("user_id", "extra", "a", "b").groupBy("user_id").agg(F.round(F.avg("a"), 4).alias("score"), F.round(F.avg("b"), 4).alias("outcome"), (F.max("extra") / 100.0 > 0.3).alias("extra_reads"))


@register("compaction_history", f"WITH {EVENTS} SELECT event_id, user_id, greatest(0, k - 50) AS freed, CASE WHEN cents % 2 = 0 THEN cents ELSE 0 END AS cost FROM e WHERE event_type = 'error' AND NOT (k <= 50 AND cents % 2 = 1) ORDER BY us DESC, event_id DESC LIMIT 10")
def compaction_history(spark, sf):
    """The latest ten; rows that freed nothing and cost nothing are dropped."""
    e = events(spark, sf).filter("event_type = 'error' AND NOT (k <= 50 AND cents % 2 = 1)").orderBy(F.desc("us"), F.desc("event_id")).limit(10)
    return e.select("event_id", "user_id", F.greatest(F.lit(0), F.col("k") - 50).alias("freed"), F.when(F.col("cents") % 2 == 0, F.col("cents")).otherwise(0).alias("cost"))


_REASON = "CASE WHEN k % 11 = 0 THEN 'unparseable' WHEN k % 7 = 0 THEN 'tracked' WHEN k % 5 = 0 THEN 'own' WHEN cents < 300 THEN 'below_threshold' ELSE 'backfilled' END"


@register("backfill_accounting", f"WITH {EVENTS} SELECT {_REASON} AS reason, count(*) AS sessions, sum(CASE WHEN {_REASON} = 'backfilled' THEN greatest(1, least(k * 40000 - 100, 2000000)) ELSE 0 END)::BIGINT AS tokens FROM e GROUP BY 1")
def backfill_accounting(spark, sf):
    """Skip reasons in the order they are asked; tokens of what is written are clamped to one up to two million."""
    k = F.col("k")
    reason = F.when(k % 11 == 0, "unparseable").when(k % 7 == 0, "tracked").when(k % 5 == 0, "own").when(F.col("cents") < 300, "below_threshold").otherwise("backfilled")
    e = events(spark, sf).withColumn("reason", reason)
    return e.groupBy("reason").agg(F.count("*").alias("sessions"), _sum(F.col("reason") == "backfilled", F.greatest(F.lit(1), F.least(k * 40000 - 100, F.lit(2_000_000)))).alias("tokens"))


@register("routing_what_if", f"WITH {EVENTS} SELECT event_id, k * 15 - k * 3 AS saved FROM e WHERE event_type = 'view' AND k < 60 AND cents < 20000 ORDER BY saved DESC, event_id LIMIT 8")
def routing_what_if(spark, sf):
    """Routine calls priced again at a cheaper card; the eight that would save most."""
    card = spark.createDataFrame([("big", 15), ("small", 3)], "model string, rate long")
    e = events(spark, sf).filter("event_type = 'view' AND k < 60 AND cents < 20000").withColumns({"own": F.lit("big"), "other": F.lit("small")})
    j = e.join(F.broadcast(card.select(F.col("model").alias("own"), F.col("rate").alias("r1"))), "own").join(F.broadcast(card.select(F.col("model").alias("other"), F.col("rate").alias("r2"))), "other")
    return j.select("event_id", (F.col("k") * F.col("r1") - F.col("k") * F.col("r2")).alias("saved")).orderBy(F.desc("saved"), "event_id").limit(8)


@register("routing_actual", f"""WITH {EVENTS} SELECT CASE WHEN k < 33 THEN 'low' WHEN k < 66 THEN 'mid' ELSE 'high' END AS tier, sum(cents)::BIGINT AS saved, array_to_string(list_sort(list(DISTINCT 'm' || (cents % 4))), ',') AS models FROM e WHERE event_type = 'click' GROUP BY 1""")
def routing_actual(spark, sf):
    tier = F.when(F.col("k") < 33, "low").when(F.col("k") < 66, "mid").otherwise("high")
    return events(spark, sf).filter("event_type = 'click'").groupBy(tier.alias("tier")).agg(F.sum("cents").alias("saved"), F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("m"), F.col("cents") % 4))), ",").alias("models"))


_TOOL = "CASE k % 5 WHEN 0 THEN 'file_read' WHEN 1 THEN 'code_search' WHEN 2 THEN 'web-fetch' WHEN 3 THEN 'image_make' ELSE 'bash' END"


@register("tool_audit", f"""WITH {EVENTS}, g AS (SELECT {_TOOL} AS tool, count(*) AS calls FROM e WHERE user_id % 3 = 0 GROUP BY 1) SELECT tool, calls, len(list_intersect(string_split_regex(tool, '[_-]'), ['read', 'search', 'file', 'bash'])) AS overlap,
CASE WHEN calls >= 30 AND len(list_intersect(string_split_regex(tool, '[_-]'), ['read', 'search', 'file', 'bash'])) > 0 THEN 'KEEP' WHEN calls >= 10 OR len(list_intersect(string_split_regex(tool, '[_-]'), ['read', 'search', 'file', 'bash'])) > 0 THEN 'CONSIDER' ELSE 'DISABLE' END AS verdict FROM g""")
def tool_audit(spark, sf):
    """Tools by use and by the words that their names share with the project's."""
    g = events(spark, sf).filter("user_id % 3 = 0").groupBy(F.expr(_TOOL).alias("tool")).agg(F.count("*").alias("calls"))
    same = F.size(F.array_intersect(F.split("tool", "[_-]"), F.array(*map(F.lit, ("read", "search", "file", "bash"))))).cast("long")
    return g.select("tool", "calls", same.alias("overlap"), F.when((F.col("calls") >= 30) & (same > 0), "KEEP").when((F.col("calls") >= 10) | (same > 0), "CONSIDER").otherwise("DISABLE").alias("verdict"))


_CMD = "CASE k % 4 WHEN 0 THEN 'cd /x && git status -s' WHEN 1 THEN 'sudo  pytest -q tests/a.py' WHEN 2 THEN 'FOO=1 npm run build' ELSE 'ls -la /tmp/' || k END"


@register("command_families", f"""WITH {EVENTS}, c AS (SELECT regexp_replace(regexp_replace({_CMD}, '^cd [^ ]+ && ', ''), '^(sudo|[A-Z_]+=[^ ]*) +', '') AS cmd, cents FROM e)
SELECT CASE WHEN regexp_matches(cmd, '^(git|npm) ') THEN split_part(cmd, ' ', 1) || ' ' || split_part(cmd, ' ', 2) ELSE split_part(cmd, ' ', 1) END AS family, count(*) AS runs, sum(cents // 4)::BIGINT AS shipped, sum((cents * 3) // 4)::BIGINT AS omitted FROM c GROUP BY 1""")
def command_families(spark, sf):
    """Commands by their program, with the verb of those that have one; a change of folder, sudo and settings in front are no part of it."""
    cmd = F.regexp_replace(F.regexp_replace(F.expr(_CMD), "^cd [^ ]+ && ", ""), "^(sudo|[A-Z_]+=[^ ]*) +", "")
    c = events(spark, sf).select(F.split(cmd, " ").alias("w"), "cents")
    family = F.when(F.col("w")[0].isin("git", "npm"), F.concat_ws(" ", F.col("w")[0], F.col("w")[1])).otherwise(F.col("w")[0])
    return c.groupBy(family.alias("family")).agg(F.count("*").alias("runs"), F.sum(F.floor(F.col("cents") / 4)).alias("shipped"), F.sum(F.floor(F.col("cents") * 3 / 4)).alias("omitted"))


@register("job_health", """WITH m AS (SELECT max(o_orderdate) AS t FROM orders) SELECT o_orderpriority AS queue, count(*) AS jobs, count(*) FILTER (o_orderstatus = 'P') AS running, count(*) FILTER (o_orderstatus = 'P' AND o_orderdate < t - INTERVAL 30 DAY) AS stuck,
CASE WHEN count(*) FILTER (o_orderstatus = 'P' AND o_orderdate < t - INTERVAL 30 DAY AND o_orderkey % 3 = 2) > 0 THEN 'dead' ELSE 'failed' END AS expired_state FROM orders, m GROUP BY 1""")
def job_health(spark, sf):
    """Jobs by state; a lease older than thirty days is stuck, and dead if its attempts are used up."""
    o = table(spark, sf, "orders")
    j = o.join(F.broadcast(o.agg(F.max("o_orderdate").alias("t"))))
    running = F.col("o_orderstatus") == "P"
    stuck = running & (F.col("o_orderdate") < F.col("t") - F.expr("INTERVAL 30 DAYS"))
    return j.groupBy(F.col("o_orderpriority").alias("queue")).agg(F.count("*").alias("jobs"), F.count_if(running).alias("running"), F.count_if(stuck).alias("stuck"), F.when(F.count_if(stuck & (F.col("o_orderkey") % 3 == 2)) > 0, "dead").otherwise("failed").alias("expired_state"))


@register("index_stats", "SELECT lang, source, count(*) AS n, count(DISTINCT sha256(text)) AS texts, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source))")
def index_stats(spark, sf):
    d = table(spark, sf, "documents").select("lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return d.groupingSets([["lang"], ["source"], ["lang", "source"]], "lang", "source").agg(F.count("*").alias("n"), F.countDistinct("h").alias("texts"), F.sum("n_chars").alias("chars"))


@register("flow_usage", f"""WITH {_TYPES} SELECT host AS label, sum(tokens)::BIGINT AS tokens, sum(tokens * 3)::BIGINT AS cost, round(coalesce(sum(tokens) FILTER (kind = 'cached'), 0) / nullif(coalesce(sum(tokens) FILTER (kind IN ('cached', 'prompt', 'cache_create')), 0), 0), 6) AS cache_ratio FROM t GROUP BY 1""")
def flow_usage(spark, sf):
    kind, t = F.col("kind"), F.col("tokens")
    g = typed(spark, sf).groupBy(F.col("host").alias("label")).agg(F.sum("tokens").alias("tokens"), F.sum(t * 3).alias("cost"), _sum(kind == "cached", t).alias("c"), _sum(kind.isin("cached", "prompt", "cache_create"), t).alias("i"))
    return g.select("label", "tokens", "cost", F.round(F.col("c") / F.when(F.col("i") != 0, F.col("i")), 6).alias("cache_ratio"))


@register("vote_quorum", """WITH v AS (SELECT p_brand AS task, p_type AS answer, count(*) AS votes FROM part GROUP BY 1, 2), s AS (SELECT task, sum(votes) AS total, arg_max(answer, struct_pack(v := votes, a := -ascii(answer))) AS best, max(votes) AS top FROM v GROUP BY 1)
SELECT task, total::BIGINT AS total, CASE WHEN top * 2 > total THEN best END AS majority, CASE WHEN top * 100 >= total * 18 THEN best END AS quorum FROM s""")
def vote_quorum(spark, sf):
    """The commonest answer if it has over half the votes, and if it has the quorum; else none."""
    v = table(spark, sf, "part").groupBy(F.col("p_brand").alias("task"), F.col("p_type").alias("answer")).agg(F.count("*").alias("votes"))
    s = v.groupBy("task").agg(F.sum("votes").alias("total"), F.max_by("answer", F.struct("votes", -F.ascii("answer"))).alias("best"), F.max("votes").alias("top"))
    return s.select("task", "total", F.when(F.col("top") * 2 > F.col("total"), F.col("best")).alias("majority"), F.when(F.col("top") * 100 >= F.col("total") * 18, F.col("best")).alias("quorum"))


@register("union_reducer", "SELECT p_name AS signature, min(p_partkey) AS first_id, count(*) AS copies FROM part GROUP BY 1")
def union_reducer(spark, sf):
    """Answers of all workers, one a signature, the first that came."""
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("signature")).agg(F.min("p_partkey").alias("first_id"), F.count("*").alias("copies"))


_CHECKS = {"tests": "CASE WHEN k % 7 = 0 THEN NULL ELSE k % 5 <> 0 END", "lint": "CASE WHEN cents % 11 = 0 THEN NULL ELSE cents % 3 <> 0 END", "docs": "CASE WHEN k % 3 = 0 THEN NULL ELSE TRUE END", "breach": "cents % 37 = 0"}


@register("rubric_gate", f"""WITH {EVENTS}, c AS (SELECT event_id, {", ".join(f"{v} AS {k}" for k, v in _CHECKS.items())} FROM e)
SELECT event_id, CASE WHEN breach THEN 'escalate' WHEN tests IS DISTINCT FROM TRUE THEN 'blocked' WHEN lint IS DISTINCT FROM TRUE OR docs IS DISTINCT FROM TRUE THEN 'warn' ELSE 'pass' END AS status,
CASE WHEN tests IS NULL THEN 'missing' WHEN tests THEN 'pass' ELSE 'fail' END AS tests, CASE WHEN lint IS NULL THEN 'missing' WHEN lint THEN 'pass' ELSE 'fail' END AS lint, CASE WHEN docs IS NULL THEN 'missing' WHEN docs THEN 'pass' ELSE 'warn' END AS docs FROM c""")
def rubric_gate(spark, sf):
    """Required checks block (tests) or warn (lint) if they fail or are missing, optional ones (docs) warn; a breach outranks all."""
    c = events(spark, sf).select("event_id", *[F.expr(v).alias(k) for k, v in _CHECKS.items()])
    ok = lambda n: F.coalesce(F.col(n), F.lit(False))
    says = lambda n, bad: F.when(F.col(n).isNull(), "missing").when(F.col(n), "pass").otherwise(bad).alias(n)
    status = F.when(F.col("breach"), "escalate").when(~ok("tests"), "blocked").when(~ok("lint") | ~ok("docs"), "warn").otherwise("pass")
    return c.select("event_id", status.alias("status"), says("tests", "fail"), says("lint", "fail"), says("docs", "warn"))


@register("premium_pricing", f"""WITH {EVENTS}, r AS (SELECT user_id, k AS t_in, cents % 90 AS c_read, cents % 40 AS c_write, cents % 15 AS c_write_1h, cents % 30 AS t_out FROM e)
SELECT user_id, count(*) FILTER (t_in + c_read + c_write + c_write_1h > 150) AS long_requests, sum((t_in * 30 + c_read * 3 + c_write * 375 // 10 + c_write_1h * 60 + t_out * 150) * CASE WHEN t_in + c_read + c_write + c_write_1h > 150 THEN 2 ELSE 1 END)::BIGINT AS cost FROM r GROUP BY 1""")
def premium_pricing(spark, sf):
    """A request whose input passes the threshold is priced at the premium as a whole; cache writes of an hour cost 1.6 times those of five minutes."""
    e = events(spark, sf).selectExpr("user_id", "k AS i", "cents % 90 AS r", "cents % 40 AS w", "cents % 15 AS h", "cents % 30 AS o")
    long_ = F.expr("i + r + w + h > 150")
    cost = F.expr("i * 30 + r * 3 + (w * 375) DIV 10 + h * 60 + o * 150") * F.when(long_, 2).otherwise(1)
    return e.groupBy("user_id").agg(F.count_if(long_).alias("long_requests"), F.sum(cost).alias("cost"))


@register("budget_exhaustion", f"WITH {EVENTS} SELECT user_id, day, count(*) AS calls, sum(k)::BIGINT AS tokens, count(*) > 3 AS calls_spent, sum(k) > 150 AS tokens_spent FROM e GROUP BY 1, 2 HAVING count(*) > 3 OR sum(k) > 150")
def budget_exhaustion(spark, sf):
    g = events(spark, sf).groupBy("user_id", "day").agg(F.count("*").alias("calls"), F.sum("k").alias("tokens"))
    return g.withColumns({"calls_spent": F.col("calls") > 3, "tokens_spent": F.col("tokens") > 150}).filter("calls_spent OR tokens_spent")


@register("latest_context", f"WITH {EVENTS} SELECT user_id, arg_max(struct_pack(t := k, c := cents), struct_pack(u := us, i := event_id)).t AS tokens, arg_max(cents, struct_pack(u := us, i := event_id)) AS cents, max(us) AS last_us FROM e WHERE event_type <> 'error' GROUP BY 1")
def latest_context(spark, sf):
    """The last usage row of each session."""
    last = F.max_by(F.struct("k", "cents", "us"), F.struct("us", "event_id"))
    return events(spark, sf).filter("event_type <> 'error'").groupBy("user_id").agg(last.alias("x")).select("user_id", F.col("x.k").alias("tokens"), "x.cents", F.col("x.us").alias("last_us"))


@register("char_budget_ring", f"""WITH {EVENTS}, r AS (SELECT user_id, event_id, k AS chars, event_type IN ('view', 'click') AS low, sum(k) OVER (PARTITION BY user_id ORDER BY event_type IN ('view', 'click'), us DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS upto FROM e) SELECT user_id, event_id, chars, low FROM r WHERE upto <= 400""")
def char_budget_ring(spark, sf):
    """What is kept under a budget of characters: the oldest of little signal go first, then the oldest."""
    low = F.col("event_type").isin("view", "click")
    w = Window.partitionBy("user_id").orderBy(low, F.desc("us"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, sf).select("user_id", "event_id", F.col("k").alias("chars"), low.alias("low"), F.sum("k").over(w).alias("upto")).filter("upto <= 400").drop("upto")


@register("run_checkpoints", f"WITH {EVENTS} SELECT user_id, k % 12 AS step, arg_max(event_id, struct_pack(u := us, i := event_id)) AS latest, count(DISTINCT md5(event_type || cents)) AS inputs, count(*) AS writes FROM e GROUP BY 1, 2")
def run_checkpoints(spark, sf):
    """The latest checkpoint of each step of a run, and how many different inputs it was written for."""
    return events(spark, sf).groupBy("user_id", (F.col("k") % 12).alias("step")).agg(F.max_by("event_id", F.struct("us", "event_id")).alias("latest"), F.countDistinct(F.md5(F.concat("event_type", "cents").cast("binary"))).alias("inputs"), F.count("*").alias("writes"))


@register("trace_list", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND o_orderdate >= TIMESTAMP '1995-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20")
def trace_list(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND o_orderdate >= TIMESTAMP '1995-01-01'")
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(50).select("o_orderkey", "o_orderdate")


@register("workspace_facets", "SELECT DISTINCT c_mktsegment AS workspace, n_name AS host FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY'")
def workspace_facets(spark, sf):
    c = table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'")
    return c.join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("workspace"), F.col("n_name").alias("host")).distinct()


@register("telemetry_filter", f"WITH {EVENTS} SELECT event_id, user_id FROM e WHERE day >= '2024-01-10' AND event_type IN ('error', 'purchase') AND (k % 10 = 3 OR user_id IN (SELECT user_id FROM e WHERE event_type = 'signup' AND k % 10 = 3))")
def telemetry_filter(spark, sf):
    """The host is the row's own property, or that of the event that started its session."""
    e = events(spark, sf)
    f = e.filter("day >= '2024-01-10' AND event_type IN ('error', 'purchase')")
    own = f.filter("k % 10 = 3")
    started = e.filter("event_type = 'signup' AND k % 10 = 3").select("user_id")
    return own.union(f.filter("NOT k % 10 = 3").join(started, "user_id", "left_semi").select(*f.columns)).select("event_id", "user_id")


@register("analytics_filter", f"WITH {_TYPES} SELECT event_id, kind, tool, tokens FROM t WHERE lower(kind) = lower('Tool_Call') AND contains(lower(tool), lower('EA')) ORDER BY tokens DESC, event_id LIMIT 100")
def analytics_filter(spark, sf):
    """Equality and containment without regard to case, before the limit."""
    t = typed(spark, sf).filter((F.lower("kind") == "Tool_Call".lower()) & F.lower("tool").contains("EA".lower()))
    return t.select("event_id", "kind", "tool", "tokens").orderBy(F.desc("tokens"), "event_id").limit(100)


@register("tags_and_visibility", """WITH p AS (SELECT p_partkey, p_brand AS agent, list_distinct(['t' || (p_size % 4), 't' || (p_partkey % 5), CASE WHEN p_size % 6 = 0 THEN 'agent:any' ELSE lower(p_type) END]) AS tags FROM part)
SELECT p_partkey, agent FROM p WHERE list_has_all(tags, ['t1', 't2']) AND (agent = 'Brand#3' OR list_contains(tags, 'agent:any'))""")
def tags_and_visibility(spark, sf):
    """All required tags are there, and the row is the agent's own or open to any."""
    tags = F.array_distinct(F.array(F.concat(F.lit("t"), F.col("p_size") % 4), F.concat(F.lit("t"), F.col("p_partkey") % 5), F.when(F.col("p_size") % 6 == 0, "agent:any").otherwise(F.lower("p_type"))))
    need = F.array(F.lit("t1"), F.lit("t2"))
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("agent"), tags.alias("tags"))
    return p.filter((F.size(F.array_except(need, F.col("tags"))) == 0) & ((F.col("agent") == "Brand#3") | F.array_contains("tags", "agent:any"))).select("p_partkey", "agent")
