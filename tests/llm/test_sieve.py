"""The bitmap that keeps rows without a partner out of the shuffles of the near-dedup stage."""

import random

import pytest

from tesserix.llm import neardup
from tesserix.llm.sieve import sieve, split


@pytest.mark.parametrize("bits", [1 << 26, 1 << 16, 64])
def test_every_member_passes_and_no_row_is_lost(spark, bits):
    r = random.Random(9)
    all_ids = [None, 0, -1, -(1 << 63), (1 << 63) - 1, *(r.randrange(-(1 << 40), 1 << 40) for _ in range(800))]
    members = [None, *r.sample(all_ids[1:], 300), 7]
    rows = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(all_ids + all_ids[:50])], "i long, t string")
    passed, rest = split(rows, "i", sieve(spark.createDataFrame([(i,) for i in members], "m long"), "m", bits), bits)
    passed, rest = passed.collect(), rest.collect()
    assert sorted(x["t"] for x in passed + rest) == sorted(f"t{k}" for k in range(len(all_ids) + 50))
    assert not {x["i"] for x in rest} & set(members)
    strangers = {x["i"] for x in passed} - set(members)
    assert len(strangers) <= (0 if bits > 1 << 20 else 20 if bits > 64 else 600)
    none = split(rows, "i", sieve(spark.createDataFrame([], "m long"), "m", bits), bits)
    assert none[0].count() == 0 and none[1].count() == rows.count()


def test_rows_without_a_candidate_are_not_moved(spark, docs_of, monkeypatch):
    r = random.Random(10)
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(60))) for i in range(200)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(5)] + [(None, rows[9][1]), (None, "one of its kind"), (3, rows[3][1])]
    hashed, keyed = [], []
    texts, keys = neardup.map_texts, neardup._with_keys
    monkeypatch.setattr(neardup, "map_texts", lambda docs, schema, *a, **k: hashed.append(docs.count()) or texts(docs, schema, *a, **k))
    monkeypatch.setattr(neardup, "_with_keys", lambda docs, text: keyed.append(docs.count()) or keys(docs, text))
    got = sorted(map(repr, ((x["doc_id"], x["text"]) for x in neardup.keep_one(docs_of(rows)).collect())))
    assert got == sorted(map(repr, rows[:200] + [(None, "one of its kind")]))
    assert hashed[0] == len(rows) and hashed[1] <= 16 and keyed[0] <= 16
