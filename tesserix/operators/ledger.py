"""The savings ledger: how a row is priced, folded into days, and carried over later turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def read_lever(tool: Column) -> Column:
    """Whether a tool reads: read or search by name or ending, anything cached, memory and recall."""
    t = F.replace(F.replace(F.lower(F.trim(F.coalesce(tool, F.lit("")))), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    return t.isin("read", "search", "memory") | t.endswith("_read") | t.endswith("_search") | t.contains("cache") | t.endswith("_memory") | t.contains("recall")


def priced(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows with p_tokens, p_cost, p_calls, p_calls_cost, unpriced.

    rows: kind, tokens, calls, calls_cost, cost (null if it was not stored), model. rates: model, rate (cost a token). A
    compaction is worth nothing; a row without tokens only its calls; else the stored cost counts, else the model's rate,
    else the tokens are unpriced.
    """
    r = rows.join(F.broadcast(rates.select(F.col("model").alias("_m"), "rate")), rows["model"] == F.col("_m"), "left")
    tokens, zero = F.greatest("tokens", F.lit(0)), F.lit(0).cast("long")
    reset = F.coalesce(F.col("kind") == "compaction", F.lit(False))
    known = F.col("cost").isNotNull() | (F.coalesce("rate", F.lit(0)) > 0)
    live = ~reset & (tokens > 0)
    out = r.withColumns(
        {
            "p_tokens": F.when(live & known, tokens).otherwise(zero),
            "p_cost": F.when(live & F.col("cost").isNotNull(), F.greatest("cost", zero)).when(live & known, tokens * F.col("rate")).otherwise(zero),
            "p_calls": F.when(reset, zero).otherwise(F.greatest("calls", zero)),
            "p_calls_cost": F.when(reset, zero).otherwise(F.greatest("calls_cost", zero)),
            "unpriced": F.when(live & ~known, tokens).otherwise(zero),
        }
    )
    return out.drop("_m", "rate")


def day_fold(ledger: DataFrame, turns: DataFrame, rates: DataFrame) -> DataFrame:
    """One row a session and day: what the rows of the day saved, and the day's part of the session's snapshot.

    ledger: session, us, day, kind, tool, tokens, calls, calls_cost, cost, model, spend, carry, carry_tokens (the last three of
    session_end rows). The newest snapshot counts, and carry is spread over the days by their share of saved tokens, or falls on its
    own day if none were saved. Spend falls on the snapshot's day, unless rows came after it or it has none: then the costs of the session's
    turns (session, day, cost) on their days, and the snapshot only if there are no turns.
    """
    rows = priced(ledger.filter(~F.col("kind").isin("session_end", "routing") | F.col("kind").isNull()), rates)
    tok, cost = F.col("p_tokens") + F.col("unpriced"), F.col("p_cost") + F.col("p_calls_cost")
    plain = (F.coalesce("kind", F.lit("")) == "") & read_lever(F.col("tool"))
    part = lambda test, value: F.sum(F.when(test, value).otherwise(0))
    saved = rows.groupBy("session", "day").agg(
        F.sum(cost).alias("cost"), F.sum(tok).alias("tokens"), F.sum("p_calls").alias("calls"), F.sum(F.when((cost > 0) | (tok > 0), 1).otherwise(0)).alias("turns"),
        part(plain, F.greatest(F.coalesce("cost", F.lit(0)), F.lit(0))).alias("read_cost"), part(plain, F.greatest("tokens", F.lit(0))).alias("read_tokens"),
        part(F.col("kind") == "output_style", F.greatest("tokens", F.lit(0))).alias("output_tokens"), part(F.col("kind") == "output_style", F.greatest(F.coalesce("cost", F.lit(0)), F.lit(0))).alias("output_cost"),
        part(F.col("kind") == "turn_cut", F.col("p_calls")).alias("turns_avoided"), F.max("us").alias("_last"),
    )
    routing = ledger.filter("kind = 'routing'").groupBy("session", "day").agg(F.sum(F.greatest("cost", F.lit(0))).alias("routing"), F.max("us").alias("_last"))
    end = ledger.filter("kind = 'session_end'").groupBy("session").agg(F.max_by(F.struct("us", "day", "spend", "carry", "carry_tokens"), F.struct("us", "seq")).alias("e")).select("session", "e.*")
    last = saved.select("session", "_last").union(routing.select("session", "_last")).groupBy("session").agg(F.max("_last").alias("_last"))
    whole = saved.groupBy("session").agg(F.sum("tokens").alias("_all"))
    ends = end.join(last, "session", "left").join(whole, "session", "left").withColumn("resumed", F.coalesce(F.col("_last") > F.col("us"), F.lit(False)))
    taken = turns.groupBy("session", "day").agg(F.sum("cost").alias("spend"))
    own = ends.filter("spend > 0").join(taken.select("session").distinct().withColumn("_t", F.lit(True)), "session", "left").filter("NOT resumed OR _t IS NULL").select("session", "day", "spend")
    sessions = saved.select("session").union(routing.select("session")).union(end.select("session")).distinct()
    spent = own.union(taken.join(sessions, "session", "left_semi").join(ends.filter("spend > 0 AND NOT resumed"), "session", "left_anti").select("session", "day", "spend"))
    share = F.col("tokens") / F.col("_all")
    spread = saved.join(ends.select("session", "carry", "carry_tokens", "_all"), "session").filter("tokens > 0").select("session", "day", (F.col("carry") * share).alias("carry"), (F.col("carry_tokens") * share).alias("carry_tokens"))
    lump = ends.filter("coalesce(_all, 0) = 0").select("session", "day", F.col("carry").cast("double").alias("carry"), F.col("carry_tokens").cast("double").alias("carry_tokens"))
    carried = spread.union(lump)
    keys = ["session", "day"]
    out = saved.drop("_last").join(routing.drop("_last"), keys, "full").join(spent, keys, "full").join(carried, keys, "full")
    names = ["cost", "tokens", "calls", "turns", "spend", "carry", "routing", "read_cost", "read_tokens", "carry_tokens", "output_tokens", "output_cost", "turns_avoided"]
    return out.select(*keys, *(F.coalesce(n, F.lit(0)).alias(n) if n not in ("carry", "carry_tokens") else F.round(F.coalesce(n, F.lit(0.0)), 4).alias(n) for n in names))


def carry(rows: DataFrame, turns: DataFrame, resets: DataFrame, ceiling: int) -> DataFrame:
    """turn_id, window, segment, carry_tokens, carry_cost: what earlier rows of a turn's context window saved it.

    rows: window, us, tokens, rate; turns: window, us, turn_id; resets: window, us. A reset at or before a row or turn begins a
    new segment. Rows count oldest first up to the ceiling, the one that crosses it in part, at its own rate. What a row can add
    depends on the rows before it alone, so a running sum takes the place of the join of rows with all later turns.
    """
    none = F.lit(None).cast("long")
    every = (
        rows.select("window", "us", F.lit(1).alias("kind"), F.col("tokens").cast("long").alias("tokens"), F.col("rate").cast("long").alias("rate"), none.alias("turn_id"))
        .union(turns.select("window", "us", F.lit(2), none, none, "turn_id"))
        .union(resets.select("window", "us", F.lit(0), none, none, none))
    )
    by = Window.partitionBy("window").orderBy("us")
    seg = every.withColumn("segment", F.count_if(F.col("kind") == 0).over(by.rangeBetween(Window.unboundedPreceding, 0))).filter("kind > 0")
    inside = Window.partitionBy("window", "segment")
    before = F.coalesce(F.sum("tokens").over(inside.orderBy("us", "kind", "tokens", "rate").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    adds = seg.withColumn("adds", F.when(F.col("kind") == 1, F.greatest(F.lit(0), F.least(F.col("tokens"), F.lit(ceiling) - before))).otherwise(0))
    earlier = inside.orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    out = adds.withColumn("carry_tokens", F.coalesce(F.sum("adds").over(earlier), F.lit(0))).withColumn("carry_cost", F.coalesce(F.sum(F.col("adds") * F.coalesce("rate", F.lit(0))).over(earlier), F.lit(0)))
    return out.filter("kind = 2").select("turn_id", "window", "segment", "carry_tokens", "carry_cost")


def collapse_saving(rounds: DataFrame, prices: tuple[int, int, int, int]) -> DataFrame:
    """session, baseline, kept, fraction: what is saved if each loop were one round.

    rounds: session, i, loop (null outside), t_in, t_out, c_read, c_write. The first round of a loop stays for it; a kept round reads
    from the cache what it read, less what eliminated rounds before it wrote.
    """
    at = Window.partitionBy("session").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy("session", "loop").orderBy("i"))
    gone = F.col("loop").isNotNull() & (first > 1)
    r = rounds.withColumn("gone", gone).withColumn("lost", F.coalesce(F.sum(F.when(F.col("gone"), F.col("c_write")).otherwise(0)).over(at), F.lit(0)))
    cost = lambda read: F.col("t_in") * prices[0] + F.col("t_out") * prices[1] + read * prices[2] + F.col("c_write") * prices[3]
    lean = F.greatest(F.lit(0), F.col("c_read") - F.col("lost"))
    g = r.groupBy("session").agg(F.sum(cost(F.col("c_read"))).alias("baseline"), F.sum(F.when(~F.col("gone"), cost(lean)).otherwise(0)).alias("kept"))
    return g.withColumn("fraction", F.when(F.col("baseline") > 0, F.round(F.greatest(F.lit(0.0), (F.col("baseline") - F.col("kept")) / F.col("baseline")), 6)).otherwise(F.lit(0.0)))
