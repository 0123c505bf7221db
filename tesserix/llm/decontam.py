"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of 13 words (shorter items are one window). A window occurs in a
document only if all its tokens do, so for containment the necessary prefix is its single rarest token; rarity
is the count of each benchmark token over all documents. A document probes the join with its
tokens; the place of the token in the window bounds where the window may start (positional bound) and
whether it fits (length bound); what is left is verified word by word.

The benchmark is the side that travels: it goes to the tasks in blocks of BLOCK_WORDS words, one after the other, and a
longer item is cut into overlapping pieces, so what the driver and a task hold is bounded whatever the benchmark's size. Each
block is two passes over the documents and leaves the hits of the texts that have any, under the MD5 of the text; the
hits of all blocks meet in an aggregate on that digest. A verdict depends on the text alone, so rows need no number.

Defined results: null or word-less texts have no words and no hits, and such items never occur;
items with the same id count once, and those with a null id as one item, whose words are hits like any
other and whose id is left out of the digest; rows that repeat a doc_id are judged
alone; empty tables give no rows or no hits; extra columns are ignored by find_contamination() and kept by
drop_contaminated(), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.llm.common import cut
from tesserix.llm.textmap import map_batches, map_texts, slices

GRAM = 13
BLOCK_WORDS = 200_000
HITS = "key string, n_words long, spans array<array<int>>, items array<string>, whole boolean"
#: Bytes of words stay (digits, letters, everything past ASCII), A-Z fall to a-z, the rest are gaps.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def item_windows(words: list[bytes], gram: int = GRAM) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + gram]) for i in range(max(1, len(words) - gram + 1))}


def token_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each benchmark token occurs in all documents (bounded by the block's vocabulary)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        import pyarrow as pa

        known, seen = shared.value, Counter()
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                seen.update(w for w in tokens(text) if w in known)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    counts = map_batches(docs.select("text"), run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    shared.destroy()
    return {bytes(r["token"]): r["n"] for r in counts}


def _index(block: list[tuple[object, list[bytes]]], counts: dict[bytes, int], gram: int):
    """Rarest token -> [(offset, window, items that have it)]."""
    items = defaultdict(set)
    for item_id, words in block:
        for window in item_windows(words, gram):
            items[window].add(item_id)
    index = defaultdict(list)
    for window, ids in sorted(items.items()):
        offset = min(range(len(window)), key=lambda i: (counts.get(window[i], 0), window[i], i))
        index[window[offset]].append((offset, window, tuple(sorted(ids, key=str))))
    return dict(index)


def _hits(words: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set, int]:
    """Merged hit ranges of words, the ids of the items that occur, and the words of the longest window that does."""
    spans, found, n, longest = [], set(), len(words), 0
    if not index.keys().isdisjoint(words):
        for at, w in enumerate(words):
            for offset, window, ids in index.get(w, ()):
                start = at - offset
                if start >= 0 and start + len(window) <= n and tuple(words[start : start + len(window)]) == window:
                    spans.append((start, start + len(window)))
                    found.update(ids)
                    longest = max(longest, len(window))
    return merge(spans), found, longest


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, block_words: int, gram: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items, a bounded block at a time; a block ends at block_words words, and so does a piece of an item."""
    block, size, step = [], 0, max(block_words, gram)
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = tokens(row["text"])
        for at in range(0, len(words) - gram + 1 if len(words) > step else min(1, len(words)), step):
            piece = words[at : at + step + gram - 1]
            block.append((row["item_id"], piece))
            size += len(piece)
            if size >= block_words:
                yield block
                block, size = [], 0
    if block:
        yield block


def _probe(docs: DataFrame, block, gram: int) -> DataFrame:
    """HITS of the texts that hold a window of the block; whole: a window of gram words occurs."""
    counts = token_counts(docs, frozenset(w for _, words in block for w in words))
    shared = docs.sparkSession.sparkContext.broadcast(_index(block, counts, gram))

    def make():
        index = shared.value

        def each(text):
            words = tokens(text)
            spans, found, longest = _hits(words, index)
            if spans:
                key = hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()
                yield key, len(words), [[a, b] for a, b in spans], sorted(str(i) for i in found if i is not None) + [None] * (None in found), longest >= gram

        return each

    found = cut(map_texts(docs, HITS, make, ("text",)))
    shared.destroy()
    return found


def _contained(docs: DataFrame, benchmark: DataFrame, gram: int, block_words: int) -> DataFrame:
    """key, n_words, n_hit, items (sorted, then a null for those without an id), whole of each text with a hit."""
    parts = [_probe(docs, block, gram) for block in _blocks(benchmark, block_words, gram)]
    hits = docs.sparkSession.createDataFrame([], HITS)
    for part in parts:
        hits = hits.union(part)
    # Copies of a text have the same spans of a block, so sets are enough.
    merged = hits.groupBy("key").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.max("whole").alias("whole"))
    # Words in the union of the ranges: each adds what lies past the furthest end so far.
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda s, x: F.struct((s["sum"] + F.greatest(F.lit(0), x[1] - F.greatest(x[0], s["end"]))).alias("sum"), F.greatest(s["end"], x[1]).alias("end")),
        lambda s: s["sum"].cast("long"),
    )
    return merged.select("key", "n_words", covered.alias("n_hit"), "items", "whole")


def _bad(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def find_contamination(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids of occurring items, then a null for those without), contaminated."""
    found = _contained(docs, benchmark, gram, block_words).select(F.col("key").alias("_k"), "n_hit", "items")

    def make():
        def each(doc_id, text):
            yield doc_id, hashlib.md5((text or "").encode("utf-8", "surrogatepass")).hexdigest(), len(tokens(text))

        return each

    every = map_texts(docs, "doc_id long, key string, n_words long", make)
    out = every.join(found, every["key"] == found["_k"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), _bad(n_hit, F.col("n_words")).alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without a passage of the benchmark, columns unchanged.

    A window of gram words is a passage in a document of any length, so a share of the words is no excuse for it.
    Items of fewer words may be plain phrases; a document goes for those if it is contaminated by find_contamination().
    The digests of those that go are sent to the tasks if Spark knows that they are few.
    """
    goes = F.col("whole") | _bad(F.col("n_hit"), F.col("n_words"))
    bad = cut(_contained(docs, benchmark, gram, block_words).filter(goes).select("key"))
    return docs.join(bad, F.md5(docs["text"].cast("binary")) == bad["key"], "left_anti")
