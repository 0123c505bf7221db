"""SimHash near-duplicates by the generalised pigeonhole.

Fingerprints: 64 bits over the XXH64 (seed 42) of three-word shingles, repeats included.
Equal fingerprints are one class before anything is joined, so groups of copies cost one row.
The 64 bits are dealt into parts of correlated bits (greedy, on the co-occurrence counts of all
distinct fingerprints). If the thresholds t_i of the parts satisfy sum(t_i + 1) = RADIUS + 1, two fingerprints
at RADIUS or fewer bits agree in some part up to t_i bits. A dynamic program picks the t_i (and
-1, which skips a part) that cost least: probes are a ball of keys around each fingerprint, candidates are
estimated from the bit frequencies. The probe join is an equi-join on (part, key); it verifies the distance inside
the join and gives out true links between distinct fingerprints only. Their components are found by
alternating stars.

Defined results: a null, empty or word-less text has fingerprint zero, linked like any other; under three
words the whole sequence is one shingle; rows that repeat a doc_id are documents of their own with one
id; a null doc_id never names a component unless it is alone; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.llm.common import cut
from tesserix.llm.components import connected
from tesserix.llm.textmap import map_batches, map_texts

BITS = 64
SHINGLE = 3
RADIUS = 3
SEED = 42
#: Cost of verifying a candidate relative to shuffling a probe row.
PAIR_COST = 0.1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: -shingle] + 1).tolist()]
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray) -> int:
    """Signed: each bit is set that is set in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    def make():
        def each(doc_id, text) -> Iterator[tuple]:
            yield doc_id, fingerprint(text, shingle)

        return each

    return map_texts(docs, "doc_id long, fp long", make)


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints, and how many of them have bits i and j set, over all of them."""

    def count(batches):
        import pyarrow as pa

        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy().astype("<i8"))
            for at in range(0, len(values), 1 << 14):
                bits = np.unpackbits(values[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
                n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["at", "n"])

    rows = map_batches(prints.select("fp"), count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["at"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of near-equal width; each grows by the bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, out = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        first = max(left, key=lambda b: (corr[b, left].sum() - corr[b, b], -b))
        part = [first]
        left.remove(first)
        while len(part) < width:
            nxt = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(nxt)
            left.remove(nxt)
        out.append(sorted(part))
    return out


def _near(q: np.ndarray, most: int) -> list[float]:
    """Chance that two fingerprints differ in at most 0, 1, .. bits of a part (q: chance that each differs)."""
    dist = np.zeros(most + 2)
    dist[0] = 1.0
    for x in q:
        dist[1:] = dist[1:] * (1 - x) + dist[:-1] * x
        dist[0] *= 1 - x
        dist[-1] = 0
    return np.cumsum(dist[: most + 1]).tolist()


def allocate(n: int, both: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits of a part, its threshold) of least cost over two to radius + 1 parts."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list] = (float("inf"), [])
    for parts in range(2, radius + 2):
        groups = group_bits(n, both, parts)
        cost = []
        for bits in groups:
            near = _near(differ[bits], radius)
            probes = np.cumsum([comb(len(bits), t) for t in range(radius + 1)])
            cost.append([0.0] + [n * (1 + float(probes[t])) + PAIR_COST * n * n / 2 * near[t] for t in range(radius + 1)])
        # table[s]: least cost of the parts so far that spend s of the radius + 1 units.
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in cost:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for spent, (so_far, chosen) in table.items():
                for t in range(radius + 2 - spent):
                    total = so_far + c[t]
                    if spent + t not in nxt or total < nxt[spent + t][0]:
                        nxt[spent + t] = (total, [*chosen, t])
            table = nxt
        total, chosen = table[radius + 1]
        if total < best[0]:
            best = (total, [(bits, t - 1) for bits, t in zip(groups, chosen) if t])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a < b: distinct fingerprints at radius or fewer bits. prints: fp, distinct."""
    n, both = bit_statistics(prints)
    index, probe = None, None
    for k, (bits, t) in enumerate(allocate(n, both, radius)):
        mask = _signed(sum(1 << b for b in bits))
        ball = [_signed(sum(1 << b for b in flips)) for size in range(t + 1) for flips in combinations(bits, size)]
        key = F.col("fp").bitwiseAND(F.lit(mask))
        here = prints.select(F.lit(k).alias("part"), key.alias("key"), F.col("fp").alias("b"))
        there = prints.select(F.lit(k).alias("part"), key.alias("_key"), F.col("fp").alias("a"))
        there = there.select("part", "a", "_key", F.explode(F.array(*[F.lit(x) for x in ball])).alias("_flip")).select("part", F.col("_key").bitwiseXOR(F.col("_flip")).alias("key"), "a")
        index = here if index is None else index.union(here)
        probe = there if probe is None else probe.union(there)
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return probe.join(index, (probe["part"] == index["part"]) & (probe["key"] == index["key"]) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long), component_id (least doc_id reachable)."""
    prints = cut(fingerprints(docs, shingle))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = connected(links(classes.select("fp"), radius))
    member = classes.join(groups, classes["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = cut(member.groupBy("component").agg(F.min("least").alias("component_id")))
    lookup = cut(member.join(names, "component").select(F.col("fp").alias("_fp"), "component_id"))
    return prints.join(lookup, prints["fp"] == lookup["_fp"]).select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
