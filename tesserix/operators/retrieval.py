"""Lexical and vector retrieval, fusion and its measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0)


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, bm25 of the documents with any of the terms: one scan, one small aggregate."""
    toks = docs.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t"))

    def hits(q: str) -> Column:
        return F.size(F.filter("t", lambda x: x == q))

    tf = toks.select("doc_id", F.size("t").alias("len"), *[hits(q).alias(f"tf{i}") for i, q in enumerate(terms)])
    stats = tf.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return tf.join(F.broadcast(stats)).select("doc_id", score.alias("bm25")).filter("bm25 > 0")


def cosine(a: Column, b: Column) -> Column:
    """Zero if either norm is."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


#: Queries that travel to the tasks at once, and vectors scored against them at once.
QUERY_BLOCK, VECTOR_CHUNK = 4096, 512


def _units(rows: list, dim: int):
    """Rows over their norms; a norm of zero leaves zeros."""
    import numpy as np

    m = np.array(rows, np.float64).reshape(len(rows), dim)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _block_top(vectors: DataFrame, block: list[tuple[int, int, list[float]]], k: int) -> DataFrame:
    """_q, query_id, vec_id, score: the k best of each task for each query of a block (number, id, embedding) of one dimension."""
    dim = len(block[0][2])
    shared = vectors.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids = np.array([i for _, i, _ in shared.value], np.int64)
        queries = _units([e for _, _, e in shared.value], dim).T
        floor = np.full(len(ids), -np.inf)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            for at in range(0, batch.num_rows, VECTOR_CHUNK):
                part = batch.slice(at, VECTOR_CHUNK)
                rows = [(i, e) for i, e in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if i is not None and e is not None and len(e) == dim and None not in e]
                if not rows:
                    continue
                vec = np.array([i for i, _ in rows], np.int64)
                score = np.round(_units([e for _, e in rows], dim) @ queries, 6) + 0.0
                v, q = np.nonzero((score >= floor) & (vec[:, None] != ids))
                q, i, s = (np.concatenate(x) for x in zip(best, (q, vec[v], score[v, q])))
                order = np.lexsort((i, -s, q))
                q, i, s = q[order], i[order], s[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                last = rank == k - 1
                floor[q[last]] = s[last]
                best = tuple(x[rank < k] for x in (q, i, s))
        numbers = np.array([n for n, _, _ in shared.value], np.int64)
        q, i, s = best
        yield pa.RecordBatch.from_arrays([pa.array(numbers[q]), pa.array(ids[q]), pa.array(i), pa.array(s)], names=["_q", "query_id", "vec_id", "score"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "_q long, query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k rows closest to each row of queries (vec_id, embedding), exact; a row is not its own neighbour.

    Queries travel in blocks of at most QUERY_BLOCK rows of one dimension, one pass over the vectors each; a task holds the k best so far
    of its block. Rows without an id or an embedding, and vectors of another dimension than the query's, are not scored.
    """
    blocks: dict[int, list] = {}
    parts: list[DataFrame] = []
    for n, row in enumerate(queries.select("vec_id", "embedding").toLocalIterator()):
        if row["vec_id"] is None or not row["embedding"] or None in row["embedding"]:
            continue
        block = blocks.setdefault(len(row["embedding"]), [])
        block.append((n, row["vec_id"], row["embedding"]))
        if len(block) == QUERY_BLOCK:
            parts.append(_block_top(vectors, blocks.pop(len(row["embedding"])), k))
    parts += [_block_top(vectors, b, k) for b in blocks.values()]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    place = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("_place", place).filter(F.col("_place") <= k).select("query_id", "vec_id", "score")


def fuse(rankings: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion of (doc_id, rank) tables."""
    parts = [r.select("doc_id", (F.lit(w) / (k + F.col("rank"))).alias("s")) for r, w in rankings]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("doc_id").agg(F.sum("s").alias("score"))


def ranked(scores: DataFrame, by: str, top: int) -> DataFrame:
    """doc_id, rank of the best rows; the limit comes first, so the rank window holds top rows."""
    best = scores.orderBy(F.desc(by), "doc_id").limit(top)
    return best.select("doc_id", F.row_number().over(Window.orderBy(F.desc(by), "doc_id")).alias("rank"))


def additive_gate(lexical: DataFrame, semantic: DataFrame, k: int, base: int = 60) -> DataFrame:
    """doc_id, score, semantic_only: lexical hits keep their lexical score alone; of the first k of the vector list, those that are no lexical hit get theirs."""
    a = lexical.select("doc_id", F.col("rank").alias("lr"))
    s = semantic.filter(F.col("rank") <= k).select("doc_id", F.col("rank").alias("sr"))
    g = a.join(s, "doc_id", "full")
    return g.select("doc_id", (1.0 / (base + F.coalesce("lr", "sr"))).alias("score"), F.col("lr").isNull().alias("semantic_only"), "sr")


def demote(rows: DataFrame, key: list[str], pos: str, capped: Column, window: int) -> DataFrame:
    """rows with rank: the head of window places has at most a quarter (one at least) of capped rows; all others follow in their order."""
    w = Window.partitionBy(*key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    most = max(1, window // 4)
    r = rows.withColumn("_ok", ~capped | (F.count_if(capped).over(w) <= most))
    r = r.withColumn("_head", F.col("_ok") & (F.count_if(F.col("_ok")).over(w) <= window))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(~F.col("_head"), pos))).drop("_ok", "_head")
