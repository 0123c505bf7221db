"""MinHash signatures and what is built on them, feature-hash embeddings, deltas and greedy packing."""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserix.shared import cut

#: The constants of a signature are drawn with a fixed seed: first all factors from 1 on, then all shifts from 0 on, up to the prime.
PRIME, PERMS, SEED = (1 << 61) - 1, 128, 1
_DRAW = random.Random(SEED)
FACTORS = [_DRAW.randint(1, PRIME) for _ in range(PERMS)]
SHIFTS = [_DRAW.randint(0, PRIME) for _ in range(PERMS)]
_MAX = 0xFFFFFFFF
#: Words whose hashes a Python worker keeps.
CACHE_WORDS = 60_000


def _fold(x: np.ndarray) -> np.ndarray:
    """The same modulo the prime, at most seven over it."""
    return (x & np.uint64(PRIME)) + (x >> np.uint64(61))


_A, _B = np.array(FACTORS, np.uint64) % np.uint64(PRIME), np.array(SHIFTS, np.uint64) % np.uint64(PRIME)
_LOW, _HIGH, _HALF = _A & np.uint64(_MAX), _A >> np.uint64(32), np.uint64((1 << 29) - 1)


def _permuted(words: list[str]) -> np.ndarray:
    """(a h + b) mod 2^61 - 1, low 32 bits, a row a word; h is the first four bytes of its SHA-1."""
    x = np.array([int.from_bytes(hashlib.sha1(w.encode()).digest()[:4], "little") for w in words], np.uint64)[:, None]
    upper = _fold(_HIGH * x)  # times 2^32, modulo the prime:
    total = ((upper & _HALF) << np.uint64(32)) + (upper >> np.uint64(29))
    total += _fold(_LOW * x)
    total += _B
    total = _fold(total)
    total -= np.uint64(PRIME) * (total >= PRIME)
    return total.astype(np.uint32)


class _Permuted:
    """The rows of words seen, in one table; a full one begins anew, so frequent words are soon back."""

    def __init__(self, words: int):
        self.at: dict[str, int] = {}
        self.table = np.empty((words, PERMS), np.uint32)

    def least(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > len(self.table):
            self.at.clear()
            new = words
        if len(new) > len(self.table):
            return _permuted(words).min(axis=0)
        if new:
            start = len(self.at)
            self.table[start : start + len(new)] = _permuted(new)
            self.at.update(zip(new, range(start, start + len(new))))
        return self.table[[self.at[w] for w in words]].min(axis=0)


@lru_cache(maxsize=1)
def _seen() -> _Permuted:
    """One per Python worker."""
    return _Permuted(CACHE_WORDS)


def signature(tokens) -> list[int]:
    """The least of each slot over the distinct tokens."""
    words, out = list(set(tokens)), np.full(PERMS, _MAX, np.uint32)
    for at in range(0, len(words), 512):
        out = np.minimum(out, _seen().least(words[at : at + 512]))
    return out.astype(np.int64).tolist()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, signature over the lower-cased words; a text without words has the largest number in every slot."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [signature((t or "").lower().split()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, signature array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Share of equal slots."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def similar_links(prints: DataFrame, least: float, bands: int = 32) -> DataFrame:
    """a, b: in each band of equal slots, the members whose estimated likeness to the band's least id reaches the bound; no pairs within a band."""
    rows = PERMS // bands
    at = prints.select("doc_id", "signature", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(F.slice("signature", k * rows + 1, F.lit(rows))))).alias("band", "key"))
    first = at.groupBy("band", "key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = at.join(first, ["band", "key"]).filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    sig = prints.select(F.col("doc_id").alias("_i"), F.col("signature").alias("_s"))
    j = met.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")
    return j.filter(estimate(F.col("sa"), F.col("sb")) >= least).select("a", "b")


def clusters(links: DataFrame) -> DataFrame:
    """node, cluster (the least node reachable): least labels spread, and every round follows the label of the label, so long chains halve."""
    e = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = cut(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("l")))
    while True:
        near = e.join(label.select(F.col("node").alias("b"), "l"), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("m"))
        step = label.join(near, "node").select("node", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        jump = step.join(step.select(F.col("node").alias("_n"), F.col("l").alias("_l")), step["l"] == F.col("_n"), "left").select("node", "was", F.least("l", F.coalesce("_l", "l")).alias("l"))
        nxt = cut(jump)
        label = nxt.select("node", "l")
        if nxt.filter("was <> l").isEmpty():
            return label.select("node", F.col("l").alias("cluster"))


def _slot(gram: str, dim: int, sign: int) -> int:
    """The slot of a gram, dim higher if its sign is minus."""
    d = hashlib.sha256(gram.encode()).digest()
    return int.from_bytes(d[:4], "big") % dim + (0 if d[sign] & 1 else dim)


_LETTERS = "_0123456789abcdefghijklmnopqrstuvwxyz"
_NUMBER = np.zeros(256, np.int64)
_NUMBER[list(_LETTERS.encode())] = range(len(_LETTERS))


@lru_cache(maxsize=2)
def _triples(dim: int) -> np.ndarray:
    """Slots of all that three letters can spell."""
    return np.array([_slot(a + b + c, dim, 5) for a in _LETTERS for b in _LETTERS for c in _LETTERS], np.int64)


@lru_cache(maxsize=CACHE_WORDS)
def _word(word: str, dim: int) -> int:
    return _slot(word, dim, 4)


def embed(text: str, dim: int) -> list[float]:
    """Feature hashing: a signed count for each word and a quarter for each three characters of the joined words, over its length."""
    words = re.findall("[a-zA-Z0-9_]+", text.lower())
    n = _NUMBER[np.frombuffer("_".join(words).encode(), np.uint8)]
    counts = np.zeros(2 * dim)
    if words:
        counts += np.bincount([_word(w, dim) if len(w) <= 64 else _slot(w, dim, 4) for w in words], minlength=2 * dim)
    if len(n) > 2:
        k = len(_LETTERS)
        counts += 0.25 * np.bincount(_triples(dim)[(n[:-2] * k + n[1:-1]) * k + n[2:]], minlength=2 * dim)
    out = counts[:dim] - counts[dim:]  # quarters, so exact in any order
    norm = float((out * out).sum()) ** 0.5
    return (out / norm if norm else out).tolist()


def embeddings(docs: DataFrame, dim: int = 64) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([embed(t or "", dim) for t in part.column(1).to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "embedding"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, embedding array<double>")


def to_embed(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """The rows whose text is not in the cache (digest, model, dim) of the model and dimension asked for; equal texts once."""
    d = docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    first = d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return first.join(cache.select("digest"), "digest", "left_anti")


def delta(old: str | None, new: str | None) -> str | None:
    """A unified diff without context if it is under half of the new text, else none; none for a first or an equal version."""
    import difflib

    if old is None or new is None or old == new:
        return None
    out = "\n".join(difflib.unified_diff(old.split("\n"), new.split("\n"), "old", "new", lineterm="", n=0))
    return "[delta]\n" + out if 2 * len(out) < len(new) else None


def deltas(versions: DataFrame) -> DataFrame:
    """key, version, delta. versions: key, version, text; each is held against the one before."""
    v = versions.withColumn("old", F.lag("text").over(Window.partitionBy("key").orderBy("version")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [delta(o, n) for o, n in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], names=["key", "version", "delta"])

    return v.select("key", "version", "old", "text").mapInArrow(run, "key long, version long, delta string")


def greedy_pack(items: DataFrame, key: str, budget: int) -> DataFrame:
    """key, used, kept (ids in the order taken): best score first (ties by id), what doesn't fit is passed over.

    items: key, id, cost, score. The items of a key are folded in one row, so a key is to be a query with a bounded list of results.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "cost")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def take(acc, x):
        fits = acc["used"] + x["cost"] <= budget
        return F.struct((acc["used"] + F.when(fits, x["cost"]).otherwise(0)).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x["id"]))).otherwise(acc["kept"]).alias("kept"))

    g = items.select(key, F.col("id").cast("long").alias("id"), F.col("cost").cast("long").alias("cost"), "score").groupBy(key).agg(ordered.alias("l"))
    return g.select(key, F.aggregate("l", start, take).alias("x")).select(key, "x.used", "x.kept")


def knapsack(costs: list[int], values: list[int], budget: int) -> list[int]:
    """Positions of the items of most value within the budget; of equal value the least cost, then the earlier items."""
    best: dict[int, tuple[int, tuple[int, ...]]] = {0: (0, ())}
    for i, (c, v) in enumerate(zip(costs, values)):
        for used, (worth, chosen) in sorted(best.items(), reverse=True):
            if used + c <= budget and worth + v > best.get(used + c, (-1, ()))[0]:
                best[used + c] = (worth + v, (*chosen, i))
    return list(max(best.items(), key=lambda x: (x[1][0], -x[0]))[1][1])


def best_packs(items: DataFrame, key: str, budget: int) -> DataFrame:
    """key, value, used, kept: the exact choice for each key. items: key (string), id, cost, value; a key is a bounded list."""

    def pick(table):
        import pyarrow as pa

        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("id", "cost", "value"))))
        at = knapsack([r[1] for r in rows], [r[2] for r in rows], budget)
        return pa.table({key: pa.array([table.column(key)[0].as_py()]), "value": pa.array([sum(rows[i][2] for i in at)], pa.int64()), "used": pa.array([sum(rows[i][1] for i in at)], pa.int64()), "kept": pa.array([[rows[i][0] for i in at]], pa.list_(pa.int64()))})

    return items.select(key, "id", "cost", "value").groupBy(key).applyInArrow(pick, f"{key} string, value long, used long, kept array<long>")
