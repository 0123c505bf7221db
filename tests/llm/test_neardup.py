"""The near-dedup stage of the pipeline against brute force over all pairs."""

import random

import pyarrow.parquet as pq

import corpus_pipeline
from tesserix.llm import neardup, quality

SF = "/root/testdata/sf0.001"


def brute_sets(texts):
    out = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split(" ")
        w = [x for x in w if x]
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_kept(rows):
    """Index of the row of least rank of each component."""
    sets, up = brute_sets([t for _, t in rows]), list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (5 * len(a & b) >= 4 * len(a | b)) and (bool(a) == bool(b)):
                up[top(i)] = top(j)
    best = {}
    for i, (d, t) in enumerate(rows):
        best.setdefault(top(i), []).append(((d is None, d or 0), i))
    return [min(v)[1] for v in best.values()]


def edited(r, words, changes):
    w = list(words)
    for at in r.sample(range(len(w)), changes):
        w[at] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_near_copies_of_similarity_four_fifths_go(docs_of):
    r = random.Random(11)
    rows, at = [], 0
    for size, changes in ((100, 1), (100, 2), (200, 2), (200, 4), (400, 4), (400, 8), (1000, 17), (60, 6), (200, 9), (200, 12)):
        for _ in range(6):
            words = [f"w{r.randrange(3000)}" for _ in range(size)]
            rows += [(at + 1, edited(r, words, changes)), (at, " ".join(words)), (at + 2, " ".join(words).upper())]
            at += 3
    chain = [f"c{i}" for i in range(200)]
    for k in range(8):
        chain = edited(r, chain, 3).split(" ")
        rows.append((5000 - k, " ".join(chain)))
    got = sorted(x["doc_id"] for x in neardup.keep_one(docs_of(rows)).collect())
    assert got == sorted(rows[i][0] for i in brute_kept(rows))
    assert 1 in set(range(at)) - set(got)


def test_one_row_of_each_component_stays(docs_of):
    r = random.Random(12)
    a, b, c = ([f"{x}{r.randrange(999)}" for _ in range(120)] for x in "abc")
    rows = [(1, " ".join(a)), (7, edited(r, a, 1)), (7, " ".join(b)), (3, edited(r, b, 1)), (9, " ".join(c)), (9, edited(r, c, 1)), (9, " ".join(c))]
    rows += [(None, edited(r, a, 1)), (None, "x y"), (None, "x y"), (None, "other words here"), (4, None), (5, " "), (None, ""), (6, "p q r"), (8, "p q r s")]
    kept = neardup.keep_one(docs_of(rows))
    got = sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=repr)
    assert len(got) == len(brute_kept(rows))
    assert [i for i, _ in got].count(9) == 1 and [i for i, _ in got].count(None) == 2
    assert {i for i, _ in got} == {1, 3, 4, 6, 8, 9, None} and 7 not in {i for i, _ in got}
    assert neardup.keep_one(docs_of([])).count() == 0


def test_pipeline_stage_on_the_test_data(spark):
    clean = quality.keep_clean(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [(x["doc_id"], " ".join((x["text"] or "").split())) for x in clean.collect()]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    got = sorted(x["doc_id"] for x in stage(spark, clean, SF).collect())
    assert got == sorted(rows[i][0] for i in brute_kept(rows))
    ids = set(pq.read_table(f"{SF}/documents.parquet").column("doc_id").to_pylist())
    assert {145, 177} <= ids - set(got)
