"""Near-duplicates by word shingles: five words, Jaccard similarity of four fifths or more, verified exactly.

Documents of equal words are one class before anything is joined. Candidates of a class come from two sources:

- its SimHash over the five-word shingles and the probes of the generalised pigeonhole (simhash.links), which reach classes
  at up to three differing bits. Sets at similarity 0.8 differ in ten bits of 64 on average, and a radius that wide would
  make a large share of all pairs candidates, so this alone can't find them all;
- so BANDS keys of ROWS minima each over the same shingle hashes: two sets at similarity s share a key with chance
  1 - (1 - s^6)^48, which misses one pair in two million at 0.8 and fewer above.

Classes that share a key or a fingerprint are linked to the least of them only, so no pair is formed; the
components of these links are the candidate groups. The set of a class with candidates moves once, to its group, where a
search from set to set over an inverted list finds every pair that is similar enough, so the components are
those of all true links among candidates. A candidate group is held by one task. Rows that a bitmap of ids (tesserix.llm.sieve)
shows to be neither candidates nor in doubt at the end are in no shuffle.

Defined results: null, empty and word-less texts are one class, similar to nothing else; under five words the whole
sequence is one shingle; of each component one row stays: that of the least id (null is the largest), then
of the least digest of the words, then of the least text; an empty table gives no rows; all columns are kept, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tesserix.llm.common import cut
from tesserix.llm.components import connected
from tesserix.llm.sieve import sieve, split
from tesserix.llm.simhash import links, majority
from tesserix.llm.textmap import map_batches, map_texts, slices

SHINGLE = 5
#: Least similarity, as a fraction.
SIMILAR = (4, 5)
BANDS = 48
ROWS = 6
SEED = 42
_MIX = np.random.default_rng(SEED).integers(1, 1 << 63, (3, BANDS * ROWS), dtype=np.uint64)
_FACTORS, _SHIFTS = _MIX[0] * np.uint64(2) + np.uint64(1), _MIX[1]
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def key_of(words: list[bytes]) -> str:
    """128-bit digest of the words."""
    from xxhash import xxh3_128_hexdigest

    return xxh3_128_hexdigest(b" ".join(words))


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxh64_intdigest(joined, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-SHINGLE] + 1).tolist()]
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())), "<u8", len(starts)))


def bands(hashes: np.ndarray) -> list[int]:
    """Signed keys, one a band; the number of the band is part of the key."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 10):
        part = hashes[at : at + (1 << 10)]
        least = np.minimum(least, (_FACTORS[:, None] * part[None, :] + _SHIFTS[:, None]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ (key >> np.uint64(31))) * _FOLD + column
    return key.view(np.int64).tolist()


def components(sets: list[np.ndarray]) -> list[list[int]]:
    """Components of the sets under similarity, by search over an inverted list; each set is visited once."""
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(flat, kind="stable")
    holders = np.repeat(np.arange(len(sets)), sizes)[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(flat))])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    new, out = np.ones(len(sets), bool), []
    for start in range(len(sets)):
        if not new[start]:
            continue
        new[start] = False
        group = [start]
        for i in group:
            common = np.bincount(np.concatenate([holders[first[x] : first[x + 1]] for x in flat[bounds[i] : bounds[i + 1]]]), minlength=len(sets))
            found = np.flatnonzero(new & (SIMILAR[1] * common >= SIMILAR[0] * (sizes[i] + sizes - common)))
            new[found] = False
            group += found.tolist()
        out.append(group)
    return out


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of each row; key, least id, fingerprint (null without words) and bands of each class."""

    def make():
        def each(doc_id, text) -> Iterator[tuple]:
            words = words_of(text)
            hashes = shingles(words)
            yield doc_id, key_of(words), majority(hashes) if len(hashes) else None, bands(hashes)

        return each

    prints = cut(map_texts(docs, "doc_id long, key string, fp long, bands array<long>", make))
    return prints.select("doc_id", "key"), cut(prints.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))


def _node():
    return F.conv(F.substring("key", 17, 16), 16, -10).cast("long")


def _candidates(classes: DataFrame) -> DataFrame:
    """key, least, component of the classes that share a band with another or have fingerprints a few bits apart."""
    prints = classes.filter("fp IS NOT NULL").select(_node().alias("node"), "fp")
    first = cut(prints.groupBy("fp").agg(F.min("node").alias("lo")))
    same = prints.join(first, "fp").filter("node <> lo").select(F.col("node").alias("a"), F.col("lo").alias("b"))
    near = links(first.select("fp")).join(first.select(F.col("fp").alias("a"), F.col("lo").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("lo").alias("y")), "b").select("x", "y")
    held = classes.select(_node().alias("node"), F.explode("bands").alias("band"))
    leaders = held.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select(F.col("band").alias("_band"), "lo")
    banded = held.join(leaders, held["band"] == leaders["_band"]).filter("node <> lo").select(F.col("node").alias("a"), F.col("lo").alias("b"))
    groups = connected(banded.union(same).union(near).distinct())
    named = classes.select("key", "least", _node().alias("_node"))
    return cut(named.join(groups, named["_node"] == groups["node"]).select("key", "least", "component"))


def _losers(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """key of the classes that have a similar one of less rank."""

    def make():
        def each(doc_id, text) -> Iterator[tuple]:
            words = words_of(text)
            yield doc_id, key_of(words), shingles(words).tobytes()

        return each

    def group(table):
        import pyarrow as pa

        rows = {k: (i is None, i or 0, k, h) for k, i, h in zip(*(table.column(c).to_pylist() for c in ("key", "least", "hashes")))}
        ranked = [rows[k] for k in sorted(rows)]
        gone = []
        for part in components([np.frombuffer(r[3], "<u8") for r in ranked]):
            gone += sorted((ranked[i][:3] for i in part))[1:]
        return pa.table({"key": pa.array([k for _, _, k in gone], pa.string())})

    held = split(docs, "doc_id", sieve(candidates, "least"))[0]
    sets = map_texts(held, "_id long, _key string, hashes binary", make, chunk=256)
    moved = sets.join(candidates, (sets["_key"] == candidates["key"]) & sets["_id"].eqNullSafe(candidates["least"]))
    return moved.select("component", "key", "least", "hashes").groupBy("component").applyInArrow(group, "key string")


def _with_keys(docs: DataFrame, text: str) -> DataFrame:
    """docs and _key, the digest of the words."""
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, 1024):
            keys = pa.array([key_of(words_of(t)) for t in part.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, keys], names=[*part.schema.names, "_key"])

    return map_batches(docs, run, StructType([*docs.schema.fields, StructField("_key", StringType())]))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component stays; columns unchanged, whatever their names."""
    names = docs.columns
    # Under plain names inside, so that no column of docs can clash with one of a step.
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    prints, classes = _classes(plain.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    losers = cut(_losers(plain.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), _candidates(classes)))
    stay = classes.select(F.col("key").alias("_k"), "least").join(losers, F.col("_k") == losers["key"], "left_anti")
    rows = prints.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    wins = rows.join(stay, (rows["key"] == F.col("_k")) & rows["doc_id"].eqNullSafe(F.col("least")), "left")
    # Rows that are not in this table are the only one of their class and stay.
    known = cut(wins.select("key", F.col("doc_id").alias("_id"), "n", F.col("_k").isNotNull().alias("_wins")).filter("n > 1 OR NOT _wins"))
    maybe, alone = split(plain, doc_id, sieve(known, "_id"))
    keyed = _with_keys(maybe, text)
    out = keyed.join(known, (keyed["_key"] == known["key"]) & keyed[doc_id].eqNullSafe(known["_id"]), "left").filter("_wins IS NULL OR _wins")
    if known.filter("_wins").limit(1).count():
        # Rows that share words and least id: the first by text, then any, stays.
        again = out.filter("n > 1").withColumn("_at", F.row_number().over(Window.partitionBy("_key").orderBy(text)))
        out = out.filter("n IS NULL OR n = 1").select(*plain.columns).union(again.filter("_at = 1").select(*plain.columns))
    return out.select(*plain.columns).union(alone).toDF(*names)
