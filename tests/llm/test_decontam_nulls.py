"""Benchmark items without an id count like any other."""

import hashlib

import pytest

from tesserix.llm import decontam


@pytest.mark.parametrize("block", [1, decontam.BLOCK_WORDS])
def test_items_without_an_id_are_searched(spark, docs_of, block):
    passage = " ".join(f"p{i}" for i in range(20))
    bench = spark.createDataFrame([(None, passage), (None, "q q q"), (7, "only here"), (None, None)], "item_id long, text string")
    docs = docs_of([(1, f"a b {passage} c"), (2, "only here, q q q"), (3, "nothing " * 30)])
    got = {r["doc_id"]: tuple(r)[1:] for r in decontam.digest(decontam.find_contamination(docs, bench, block_words=block)).collect()}
    sha = lambda t: hashlib.sha256(t).hexdigest()
    assert got == {1: (23, 20, 1, sha(b""), True), 2: (5, 5, 2, sha(b"7"), True), 3: (30, 0, 0, sha(b""), False)}
    assert [r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()] == [3]


def test_null_ids_against_the_sql_twin(spark, docs_of):
    import duckdb
    import pyarrow as pa

    from tesserix.llm.sql import TWINS

    items = [(None, "x y"), (None, "y z"), (4, "x y"), (5, "w")]
    rows = [(1, "x y z"), (2, "y z"), (3, "w x"), (None, "w x y z")]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]}))
    con.register("benchmark", pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": [t for _, t in items]}))
    got = decontam.digest(decontam.find_contamination(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.execute(TWINS["op2_decontamination"]).fetchall(), key=repr)
