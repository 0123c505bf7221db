"""Column names that steps use, repeated and null ids in the near-dedup stage."""

from tesserix.llm import neardup


def test_names_and_repeated_ids(docs_of):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(0, a), (602, a), (602, b), (602, b), (None, a), (None, "x y z"), (5, None), (6, None)]
    df = docs_of(rows, ", _id string, _key string, _k string, key string, n string, least string, _wins string, c0 string, node string")
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(repr, [(0, a), (602, b), (None, "x y z"), (5, None)]))
    assert {r["_id"] for r in kept.collect()} == {"x"}
