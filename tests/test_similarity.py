"""Signatures, clusters, embeddings, packing and deltas against plain versions."""

import hashlib
import itertools
import random

import pytest

from tesserix.operators import similarity as S


def test_signature_against_plain_numbers():
    tokens = [f"w{i}" for i in range(600)] + ["é"]
    hs = [int.from_bytes(hashlib.sha1(t.encode()).digest()[:4], "little") for t in tokens]
    assert S.signature(tokens) == [min((a * h + b) % S.PRIME & 0xFFFFFFFF for h in hs) for a, b in zip(S.FACTORS, S.SHIFTS)]
    draw = random.Random(1)
    assert S.FACTORS[0] == draw.randint(1, S.PRIME) and S.signature([]) == [0xFFFFFFFF] * 128


def test_clusters_against_brute_force(spark):
    r = random.Random(2)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = dict(S.clusters(spark.createDataFrame([(a, b) for a, b in pairs if a != b], "a long, b long")).collect())
    assert got == {n: top(n) for a, b in pairs if a != b for n in (a, b)}


def test_near_duplicates_keep_the_least(spark):
    base = " ".join(f"word{i}" for i in range(200))
    docs = spark.createDataFrame([(5, base), (7, base + " tail"), (3, "other text of few words"), (9, base.upper()), (11, None)], "doc_id long, text string")
    links = {tuple(r) for r in S.similar_links(S.signatures(docs), 0.8).collect()}
    assert links == {(5, 7), (5, 9)}


def test_embedding_against_plain_counts():
    text = "Def foo_bar(x): return foo_bar"
    words = ["def", "foo_bar", "x", "return", "foo_bar"]
    want = [0.0] * 32
    for w in words:
        d = hashlib.sha256(w.encode()).digest()
        want[int.from_bytes(d[:4], "big") % 32] += 1.0 if d[4] & 1 else -1.0
    joined = "_".join(words)
    for i in range(len(joined) - 2):
        d = hashlib.sha256(joined[i : i + 3].encode()).digest()
        want[int.from_bytes(d[:4], "big") % 32] += 0.25 if d[5] & 1 else -0.25
    norm = sum(x * x for x in want) ** 0.5
    assert S.embed(text, 32) == pytest.approx([x / norm for x in want]) and S.embed("--", 4) == [0.0] * 4


def test_knapsack_and_greedy(spark):
    r = random.Random(7)
    for _ in range(60):
        costs, values, budget = [r.randint(1, 9) for _ in range(8)], [r.randint(0, 9) for _ in range(8)], r.randint(0, 25)
        at = S.knapsack(costs, values, budget)
        best = max(sum(values[i] for i in c) for k in range(9) for c in itertools.combinations(range(8), k) if sum(costs[i] for i in c) <= budget)
        assert sum(values[i] for i in at) == best and sum(costs[i] for i in at) <= budget
    items = spark.createDataFrame([("q", 1, 10, 9.0), ("q", 2, 500, 5.0), ("q", 3, 7, 1.0)], "k string, id long, cost long, score double")
    assert S.greedy_pack(items, "k", 17).first()["kept"] == [1, 3]


def test_deltas(spark):
    one = "\n".join(f"line {i}" for i in range(400))
    two = one.replace("line 200\n", "line 200 EDITED\n")
    rows = [(1, 0, one), (1, 1, two), (1, 2, two), (1, 3, "\n".join(f"new {i}" for i in range(400)))]
    got = {r["version"]: r["delta"] for r in S.deltas(spark.createDataFrame(rows, "key long, version long, text string")).collect()}
    assert got[0] is None and got[2] is None and got[3] is None
    assert got[1].startswith("[delta]") and "+line 200 EDITED" in got[1] and len(got[1]) < len(two) // 2
