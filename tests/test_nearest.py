"""nearest() answers every row of its query table."""

import random

from tesserix.operators import retrieval


def test_every_query_gets_its_own_top_k(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(4)]) for i in range(120)] + [(120, [0.0] * 4), (121, None), (None, [1.0] * 4), (122, [1.0, 2.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    queries = e.filter("vec_id % 10 = 0")

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / n, 6) if n else 0.0

    whole = [(i, v) for i, v in rows if i is not None and v and len(v) == 4]
    want = []
    for q, a in whole:
        if q % 10 == 0:
            want += [(q, i, s) for s, i in sorted(((cosine(a, v), i) for i, v in whole if i != q), key=lambda x: (-x[0], x[1]))[:5]]
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    got = [tuple(x) for x in retrieval.nearest(e, queries, 5).collect()]
    assert len({q for q, _, _ in got}) == 13 and sorted(got) == sorted(want)
    assert retrieval.nearest(e, e.filter("vec_id < 0"), 5).count() == 0
