"""Packing token sequences by minimum bin slack.

Every document is cut into full windows and one remainder. What is to be packed is then the multiset of
remaining lengths: a histogram of at most CAPACITY numbers, whatever the corpus. For the longest length
left, a bitset subset-sum over the others finds the multiset that fills the window closest
to capacity; backtracking through the bitsets gives its counts; the pattern repeats as often as
the histogram allows. The plan so found has at most CAPACITY patterns of at most 63 lengths, and is
applied to the pieces by their rank among the pieces of the same length. Ranks come from
two-level counts over salted buckets, so a hot length spreads over tasks.

Defined results: a null or empty text is the end id alone; rows that repeat a doc_id are packed
apart; an empty table gives no rows; extra columns are ignored. No id is dropped or
duplicated, and sequences are the same in any run over the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserix.llm.common import cut, salted
from tesserix.llm.textmap import map_batches, map_texts
from tesserix.llm.wordids import word_ids

CAPACITY = 2048
END = (1).to_bytes(4, "little")


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full windows and one remainder of each document."""

    def make():
        encode = word_ids(tokenizer).encode

        def each(doc_id, text) -> Iterator[tuple]:
            data = encode(text or "") + END
            n, step = len(data) // 4, capacity * 4
            for at in range(0, len(data), step):
                part = data[at : at + step]
                yield doc_id, at // 4, len(part) // 4, zlib.crc32(part), n

        return each

    return map_texts(docs, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long", make)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths whose sum is closest to room from below; longer lengths first."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k_now = min(k, left)
            after = (reach | (reach << (k_now * length))) & mask
            if after != reach:
                steps.append((length, k_now, reach))
                reach = after
            left -= k_now
            k *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= k * length
            taken[length] = taken.get(length, 0) + k
    return taken


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(lengths and how often each, repetitions) until the histogram is used up."""
    counts = {x: c for x, c in histogram.items() if c}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        pattern = fill(counts, capacity - longest)
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[x] // k for x, k in pattern.items())
        for x, k in pattern.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
        out.append((pattern, times))
    return out


def _lookup(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length: rows of (first rank, how often in a sequence, first sequence, offset there)."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            k = pattern[length]
            rows.setdefault(length, []).append((used.get(length, 0), k, sequence, offset))
            used[length] = used.get(length, 0) + k * times
            offset += k * length
        sequence += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = cut(cut_pieces(docs, tokenizer, capacity).withColumn("_b", F.pmod(F.xxhash64("doc_id", "start"), F.lit(4 * max(64, salted(docs))))))
    sizes = pieces.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(_lookup(plan(histogram, capacity)))

    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_b").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("_r", F.row_number().over(inside)).join(firsts, ["length", "_b"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_first") + F.col("_r") - 1).alias("rank"))

    def place(batches):
        import pyarrow as pa

        lookup = table.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (2, 5))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                rows = lookup[int(x)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                k = rank[at] - row[:, 0]
                seq[at] = row[:, 2] + k // row[:, 1]
                off[at] = row[:, 3] + k % row[:, 1] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(seq), pa.array(off)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return map_batches(ranked, place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
