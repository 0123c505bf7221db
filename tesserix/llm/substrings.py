"""Exact removal of repeated passages by difference-cover anchors.

A window is SPAN consecutive words of one document. Any two positions share an offset below PERIOD at which both
are cover positions modulo PERIOD, so two equal windows share an aligned anchor of SPAN - PERIOD + 1 words
at cover positions. Only anchors (4 of 13 positions) of all documents are hashed and grouped. An
anchor that two contents hold marks the windows around it, the only ones that can repeat across documents;
these are extended to whole windows, hashed to 128 bits and grouped for the least document that has
each. A document loses the words of every window that a smaller document has, and of windows that it
has itself at an earlier start.

Documents of equal words are one content: their least id stands for all in both groupings, and the other copies lose
everything (or, under SPAN words, nothing) without another look. No pair is ever formed: groups
meet only in aggregates and in joins against one row a group.

Defined results: a null text has no words; a null doc_id counts as the smallest, as the least long does, and comes back as it
was; rows that repeat a doc_id never take words from each other, as neither is smaller; an empty table gives no rows; extra
columns are ignored. Contents are told apart by 64 bits of SHA-256 where anchors are counted and by all of it elsewhere. Two
different windows share their 128 bits with a chance of about 2^-115 a pair: each half is a polynomial modulo 2^64 over
64-bit hashes of the words, whose lowest bits don't depend on the order of the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.llm.common import Scratch
from tesserix.llm.textmap import map_batches, map_texts, slices

SPAN = 20
PERIOD = 13
#: Differences of these give every residue modulo PERIOD.
COVER = (0, 1, 3, 9)
ANCHOR = SPAN - PERIOD + 1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LEAST = -(1 << 63)
#: Windows of an output batch, about.
ROWS = 50_000


@lru_cache(maxsize=4)
def _powers(lane: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = _BASES[lane]
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, pow(base, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
    return up, down


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    """Hash of values[a:b] for each start and end, the same wherever the run stands."""
    size = 1 << max(12, int(len(values)).bit_length())
    up, down = _powers(lane, size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    return (sums[ends] - sums[starts]) * down[starts]


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than space, tab, line feed, vertical tab, form feed, carriage return."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors at cover positions."""
    n = len(words)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(b" ".join(words), np.uint8).astype(np.uint64) + np.uint64(0x1F3D5B79)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    last = n - ANCHOR
    at = (np.arange(0, last + 1, PERIOD)[:, None] + np.array(COVER)).ravel()
    at = at[at <= last]
    begin = np.concatenate([[0], ends[:-1] + 1])
    mixed = _runs(data, begin[at], ends[at + ANCHOR - 1], 0)
    return at, (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def windows(words: list[bytes], starts: np.ndarray) -> np.ndarray:
    """128-bit hashes of the windows at the starts, two signed columns."""
    from xxhash import xxh3_128_digest

    lanes = np.frombuffer(b"".join(map(xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    return np.stack([_runs(lanes[:, k], starts, starts + SPAN, k) for k in (0, 1)], axis=1).view(np.int64)


def repeats(hashes: np.ndarray) -> np.ndarray:
    """Which rows equal an earlier one."""
    if len(np.unique(hashes[:, 0])) == len(hashes):
        return np.zeros(len(hashes), bool)
    _, first = np.unique(hashes, axis=0, return_index=True)
    out = np.ones(len(hashes), bool)
    out[first] = False
    return out


def own_repeats(words: list[bytes]) -> np.ndarray:
    """Starts of windows that begin earlier in the same document; whole windows are hashed only if an anchor repeats."""
    _, h = anchors(words)
    if len(np.unique(h)) == len(h):
        return np.zeros(0, np.int64)
    return np.flatnonzero(repeats(windows(words, np.arange(len(words) - SPAN + 1))))


def _key(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _short(digest: str) -> int:
    return int.from_bytes(bytes.fromhex(digest[:16]), "little", signed=True)


def kept_words(words: list[bytes], starts: np.ndarray) -> list[bytes]:
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, np.minimum(starts + SPAN, len(words)), -1)
    return [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist()) if not g]


def _summaries(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, did, words, digest of the words, k (short digest), whether it repeats an anchor itself, its anchors in order."""

    def run(batches):
        import pyarrow as pa

        for part in slices(batches):
            rows, flat, ends = [], [], [0]
            for text in part.column(2).to_pylist():
                words = words_of(text)
                _, h = anchors(words)
                digest = _key(words)
                rows.append((len(words), digest, _short(digest), len(np.unique(h)) < len(h)))
                flat.append(h)
                ends.append(ends[-1] + len(h))
            n, digest, k, own = zip(*rows)
            hs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(digest), pa.array(k, pa.int64()), pa.array(own), hs],
                names=["doc_id", "did", "n_words", "digest", "k", "own", "hs"],
            )

    return map_batches(docs.select("doc_id", "did", "text"), run, "doc_id long, did long, n_words long, digest string, k long, own boolean, hs array<long>")


def _starts(marks: list[int], n: int) -> np.ndarray:
    """Starts of the windows that hold an anchor at one of the marks."""
    if n < SPAN or not marks:
        return np.zeros(0, np.int64)
    near = np.array(marks, np.int64)[:, None] - np.arange(SPAN - ANCHOR + 1)
    near = np.unique(near)
    return near[(near >= 0) & (near <= n - SPAN)]


def _windows(work: DataFrame) -> DataFrame:
    """h1, h2, did, s: the first place in the document of each window near a mark."""

    def run(batches):
        import pyarrow as pa

        def made(found):
            h, did, s = (np.concatenate(x) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(did), pa.array(s)], names=["h1", "h2", "did", "s"])

        found, rows = [], 0
        for part in slices(batches):
            for did, text, k, marks in zip(*(part.column(c).to_pylist() for c in range(4))):
                words = words_of(text)
                starts = _starts(marks or [], len(words))
                if len(starts) and _short(_key(words)) == k:
                    h = windows(words, starts)
                    first = ~repeats(h)
                    found.append((h[first], np.full(int(first.sum()), did, np.int64), starts[first]))
                    rows += len(starts)
                if rows >= ROWS:
                    yield made(found)
                    found, rows = [], 0
        if found:
            yield made(found)

    return map_batches(work.select("did", "text", "k", "marks"), run, "h1 long, h2 long, did long, s long")


def _changes(work: DataFrame) -> DataFrame:
    """did, digest, n_removed, kept (digest of the kept words) of the documents that lose words."""

    def make():
        def each(did, text, k, starts) -> Iterator[tuple]:
            words = words_of(text)
            digest = _key(words)
            if _short(digest) == k:
                gone = set(starts or ())
                gone.update(own_repeats(words).tolist())
                if gone:
                    kept = kept_words(words, np.array(sorted(gone)))
                    yield did, digest, len(words) - len(kept), _key(kept)

        return each

    return map_texts(work, "did long, digest string, n_removed long, kept string", make, ("did", "text", "k", "starts"))


def dedup_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256.

    Anchors and windows are hashed once each and stand in the shared folder while the two looks at them (which repeat, and
    where those stand) are taken; both tables go before the result is returned.
    """
    ids = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LEAST)).alias("did"), "text")
    scratch = Scratch(docs.sparkSession, "passages")
    found = scratch.keep(_summaries(ids), "anchors")
    base = scratch.keep(found.select("doc_id", "did", "n_words", "digest"), "base")
    contents = scratch.keep(found.groupBy("digest").agg(F.min("did").alias("least"), F.max("n_words").alias("n"), F.max("own").alias("own"), F.max("k").alias("k")), "contents")

    each = found.select("k", F.posexplode("hs").alias("i", "h"))
    shared = scratch.keep(each.groupBy("h").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo < hi").select("h"), "shared")
    marks = each.join(shared, "h", "left_semi").groupBy("k").agg(F.collect_set("i").alias("at"))
    # The i-th anchor of a document stands at a place that only i decides.
    place = F.transform("at", lambda i: (F.floor(i / len(COVER)) * PERIOD + F.element_at(F.array(*map(F.lit, COVER)), (i % len(COVER) + 1).cast("int"))).cast("long"))
    chosen = contents.filter(F.col("n") >= SPAN).select("least", "own", "k").join(marks.select("k", place.alias("marks")), "k", "left")
    chosen = scratch.keep(chosen.filter(F.col("marks").isNotNull() | F.col("own")).select(F.col("least").alias("_did"), "k", "marks"), "chosen")
    scratch.drop("anchors", "shared")

    work = scratch.keep(ids.join(chosen, ids["did"] == chosen["_did"]).select("did", "text", "k", "marks"), "work")
    seen = scratch.keep(_windows(work), "windows")
    known = scratch.keep(seen.groupBy("h1", "h2").agg(F.min("did").alias("least"), F.max("did").alias("most")).filter("least < most").select("h1", "h2", "least"), "known")
    later = scratch.keep(seen.join(known, ["h1", "h2"]).filter("did > least").groupBy("did").agg(F.collect_set("s").alias("starts")), "later")
    scratch.drop("windows", "known")
    changed = scratch.keep(_changes(work.select("did", "text", "k").join(later, "did", "left")).distinct(), "changed")
    scratch.drop("work", "later", "chosen")

    out = base.join(contents.select(F.col("digest").alias("_d"), "least"), base["digest"] == F.col("_d")).drop("_d")
    out = out.join(changed.select(F.col("did").alias("_c"), F.col("digest").alias("_e"), "n_removed", "kept"), (out["did"] == F.col("_c")) & (out["digest"] == F.col("_e")), "left")
    copy = (F.col("did") > F.col("least")) & (F.col("n_words") >= SPAN)
    return out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"),
    )
