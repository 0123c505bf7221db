"""Graph operators over edge tables src, dst. Loops cut their lineage in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.shared import cut as _cut


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, depth: least number of steps from any seed (depth 0 are the seeds); breadth first."""
    seen = _cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = _cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = _cut(seen.union(front))
    return seen


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (least node of its strongly connected component).

    Colouring: least labels spread forward until stable; each colour's root then claims, backwards and within
    the colour, exactly its component; claimed nodes leave and the rest go on. Nodes without both an edge in and an edge
    out are trimmed first, as each is a component alone.
    """
    left, done = _cut(edges.filter("src <> dst").select("src", "dst").distinct()), nodes(edges).select("node", F.col("node").alias("component"))
    found = None
    while True:
        while True:  # trim
            ends = left.select(F.col("dst").alias("src")).distinct()
            begins = left.select(F.col("src").alias("dst")).distinct()
            smaller = _cut(left.join(ends, "src", "left_semi").join(begins, "dst", "left_semi").select("src", "dst"))
            if smaller.count() == left.count():
                break
            left = smaller
        if left.isEmpty():
            break
        label = _cut(nodes(left).select("node", F.col("node").alias("label")))
        while True:
            offer = left.join(label, left["src"] == label["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("offer"))
            nxt = _cut(label.join(offer, "node", "left").select("node", F.least("label", F.coalesce("offer", "label")).alias("label")))
            same = nxt.join(label.withColumnRenamed("label", "_l"), "node").filter("label <> _l").isEmpty()
            label = nxt
            if same:
                break
        coloured = left.join(label.select(F.col("node").alias("src"), F.col("label").alias("_a")), "src").join(label.select(F.col("node").alias("dst"), F.col("label").alias("_b")), "dst").filter("_a = _b")
        claimed = reach(reverse(coloured.select("src", "dst")), label.filter("node = label").select("node")).join(label, "node").select("node", "label")
        found = claimed if found is None else found.union(claimed)
        gone = claimed.select("node")
        left = _cut(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return done
    return done.join(found.withColumnRenamed("label", "_l"), "node", "left").select("node", F.coalesce("_l", "component").alias("component"))


def coupling(edges: DataFrame) -> DataFrame:
    """node, ca (in), ce (out), instability ce / (ca + ce), over distinct edges."""
    e = edges.select("src", "dst").distinct()
    ca = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ca"))
    ce = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("ce"))
    both = ca.join(ce, "node", "full").select("node", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))
    return both.withColumn("instability", F.round(F.col("ce") / (F.col("ca") + F.col("ce")), 4))


def levels(edges: DataFrame) -> DataFrame:
    """node, level of a topological order; nodes on or behind a cycle have level null."""
    left, rest, level, out = _cut(edges.select("src", "dst").distinct()), _cut(nodes(edges)), 0, None
    while not rest.isEmpty():
        ready = rest.join(left.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("level", F.lit(level))
        ready = _cut(ready)
        if ready.isEmpty():
            break
        out = ready if out is None else out.union(ready)
        rest = _cut(rest.join(ready, "node", "left_anti"))
        left = _cut(left.join(ready.select(F.col("node").alias("src")), "src", "left_anti"))
        level += 1
    rest = rest.withColumn("level", F.lit(None).cast("int"))
    return rest if out is None else out.union(rest)


def pagerank(edges: DataFrame, alpha: float = 0.85, tol: float = 1e-6, max_iter: int = 100, return_dangling: bool = True) -> DataFrame:
    """node, score. Edges are weighted by how often they repeat; without return_dangling the mass of sinks is not handed on."""
    e = edges.groupBy("src", "dst").agg(F.count("*").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    share = _cut(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    every = _cut(nodes(edges).join(out.select(F.col("src").alias("node"), F.lit(True).alias("has_out")), "node", "left"))
    n = every.count()
    rank = every.select("node", "has_out", F.lit(1.0 / max(n, 1)).alias("score"))
    for _ in range(max_iter if n else 0):
        lost = rank.filter("has_out is null").agg(F.sum("score")).first()[0] or 0.0
        base = (1 - alpha) / n + (alpha * lost / n if return_dangling else 0.0)
        flow = rank.join(share, rank["node"] == share["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("flow"))
        nxt = _cut(rank.withColumnRenamed("score", "_old").join(flow, "node", "left").select("node", "has_out", "_old", (F.lit(base) + alpha * F.coalesce("flow", F.lit(0.0))).alias("score")))
        moved = nxt.agg(F.sum(F.abs(F.col("score") - F.col("_old")))).first()[0] or 0.0
        rank = nxt.drop("_old")
        if moved < n * tol:
            break
    return rank.select("node", "score")
