"""Language proportions of every document by expectation-maximisation.

A language is a smoothed distribution over hashed byte trigrams of lower-cased letters, learned
from labelled rows of the learning folds. A document is a mixture of languages: EM estimates
the proportions from the trigram likelihoods. The set of languages is chosen by penalised
likelihood: the likeliest proportions order the languages, each leading set is fitted alone, and the set
with the least Bayesian information criterion wins (a trigram counts a third, as each letter is in three).

Learning reads a bounded sample: in each language, rows whose hash falls under TRAIN_DOCS over
the language's row count, so about TRAIN_DOCS rows at most, taken from the whole table. Prediction reads
every whole text, and only the text.

Defined results: null text or no letter gives `und` and score 0; with nothing to learn from all is `und`;
a null lang teaches nothing; a null doc_id is held out; rows that repeat are judged alone; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.llm.textmap import map_batches, map_texts, slices

TRAIN_DOCS = 2000
BITS = 16
FOLDS = 5
#: EM ends when no proportion moves by more.
SETTLED = 1e-4
#: ASCII that is no letter becomes a space.
_FOLD = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def held_out(doc_id):
    """The rows of one fold in FOLDS, by the checksum of the id as text; their lang is never read."""
    return F.pmod(F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)), F.lit(FOLDS)) == 0


def grams(text: str) -> np.ndarray:
    """Hashed trigrams of the whole text."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    codes = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    codes = codes[(raw[1:-1] != 32)]
    return ((codes * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.uint16)


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, smoothing: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their trigram probabilities (2^BITS rows, a column each)."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((1 << BITS, 0))
    rates = {k: min(1.0, train_docs / n) for k, n in sizes.items()}
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in rates.items()])
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 31)) < rate * (1 << 31)).select("lang", "text")

    def count(batches):
        import pyarrow as pa

        seen: dict[str, np.ndarray] = {}
        for part in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                into = seen.setdefault(lang, np.zeros(1 << BITS, np.int64))
                into += np.bincount(grams(text), minlength=1 << BITS)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "gram", "n"])

    counts = map_batches(sample, count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((1 << BITS, len(langs)), smoothing)
    table[counts["gram"].to_numpy(), np.searchsorted(langs, counts["lang"].to_numpy().astype(object))] += counts["n"].to_numpy()
    return langs, table / table.sum(axis=0)


def fit(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the columns of p for counts n, and the log-likelihood. EM never lowers it and has one maximum here, as it is concave."""
    w = np.full(p.shape[1], 1 / p.shape[1])
    total, moved = n.sum(), p.shape[1] > 1
    while moved:
        nxt = w * ((n / (p @ w)) @ p) / total
        moved = float(np.abs(nxt - w).max()) > SETTLED
        w = nxt
    return w, float(n @ np.log(p @ w))


def has_letter(text: str) -> bool:
    """Whether any character is of Unicode category L."""
    return any(map(str.isalpha, text))


def infer(text: str | None, table: np.ndarray) -> list[tuple[int, float]]:
    """(language, proportion) of the chosen set, largest first; empty if there is nothing to judge."""
    if text is None or not table.shape[1] or not has_letter(text):
        return []
    codes, n = np.unique(grams(text), return_counts=True)
    if not len(codes):
        return [(0, 1.0 / table.shape[1])]
    p = table[codes]
    w, most = fit(p, n)
    order = np.argsort(-w, kind="stable").tolist()
    best, price = None, np.inf
    for size in range(1, len(order) + 1):
        # No set is likelier than all languages together, so from here on the penalty alone costs more.
        if -2 * most / 3 + (size - 1) * np.log(n.sum()) >= price:
            break
        wk, fitted = fit(p[:, order[:size]], n)
        cost = -2 * fitted / 3 + (size - 1) * np.log(n.sum())
        if cost < price:
            best, price = wk, cost
    return sorted(((order[i], float(x)) for i, x in enumerate(best)), key=lambda r: (-r[1], r[0]))


def predict(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, proportions ("en:0.91,fr:0.09")."""
    langs, table = learn(docs, train_docs)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def make():
        known = shared.value

        def each(doc_id, text) -> Iterator[tuple]:
            found = infer(text, known)
            yield doc_id, langs[found[0][0]] if found else "und", min(1.0, found[0][1]) if found else 0.0, ",".join(f"{langs[k]}:{x:.4f}" for k, x in found)

        return each

    out = map_texts(docs, "doc_id long, lang_pred string, score double, proportions string", make)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "proportions")
