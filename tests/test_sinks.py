"""Write semantics, audit bundles and exports."""

import json

import pytest
from pyspark.sql import functions as F

from tesserix.operators import sinks as K


def test_upserts_tombstones_and_retention(spark, tmp_path):
    t = K.VersionedTable(spark, f"{tmp_path}/t", "id long, value string, at long, gone string")
    t.upsert(spark.createDataFrame([(1, "a", 1, None), (1, "b", 2, None), (2, "c", 1, None)], t.schema), ["id"], "at")
    assert sorted(map(tuple, t.read().collect())) == [(1, "b", 2, None), (2, "c", 1, None)]
    t.tombstone(spark.createDataFrame([(2,)], "id long"), ["id"], "gone", "old")
    t.tombstone(spark.createDataFrame([(2,)], "id long"), ["id"], "gone", "again")
    assert dict(t.read().select("id", "gone").collect()) == {1: None, 2: "old"}
    assert t.prune(F.col("at") >= 2) == 1 and t.read().count() == 1 and len(t.snapshots()) == 4
    t.vacuum(1)
    assert len(t.snapshots()) == 1 and t.read().count() == 1


def test_checked_upsert_refuses_stale_versions(spark, tmp_path):
    t = K.VersionedTable(spark, f"{tmp_path}/b", "agent string, label string, value string, version long")
    h = K.VersionedTable(spark, f"{tmp_path}/h", "agent string, label string, prev_value string, new_value string, actor string")
    row = lambda value, version: spark.createDataFrame([("a", "l", value, version)], t.schema)
    t.upsert_checked(row("one", 1), ["agent", "label"], h, "me")
    t.upsert_checked(row("two", 1), ["agent", "label"], h, "me")
    assert t.read().first()["version"] == 2
    with pytest.raises(K.ConcurrencyError):
        t.upsert_checked(row("three", 1), ["agent", "label"], h, "me")
    assert t.read().first()["value"] == "two"
    assert sorted((r["prev_value"], r["new_value"]) for r in h.read().collect()) == [("", "one"), ("one", "two")]


def test_unique_inserts(spark, tmp_path):
    t = K.VersionedTable(spark, f"{tmp_path}/p", "id long, agent string, text string, digest string")
    new = lambda *rows: spark.createDataFrame(list(rows), "id long, agent string, text string")
    first = t.insert_unique(new((1, "a", "x"), (2, "a", "x"), (3, "b", "x")), "agent", "text")
    assert {tuple(r) for r in first.collect()} == {(1, 1, False), (2, 1, True), (3, 3, False)}
    again = t.insert_unique(new((9, "a", "x"), (10, "a", "y")), "agent", "text")
    assert {tuple(r) for r in again.collect()} == {(9, 1, True), (10, 10, False)}
    assert sorted(r["id"] for r in t.read().collect()) == [1, 3, 10]


def test_counters_artifacts_markers_and_ledger(spark):
    log = spark.createDataFrame([("p", True), ("p", False), ("q", True)], "k string, ok boolean")
    assert {tuple(r) for r in K.counters(log, "k").collect()} == {("p", 2, 1, 1), ("q", 1, 1, 0)}
    art = K.artifacts(spark.createDataFrame([(1, "pwd é")], "id long, text string"), lambda t: F.replace(t, F.lit("pwd"), F.lit("*"))).first()
    assert (art["bytes"], art["redacted_bytes"]) == (6, 4) and art["digest"] != art["redacted_digest"]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, body string")
    marks = K.unsynced(rows, spark.createDataFrame([], "id long, digest string"), "id", "body").filter("id = 1").select("id", "digest")
    assert [r["id"] for r in K.unsynced(rows, marks, "id", "body").collect()] == [2]
    calls = spark.createDataFrame([("t", 1, 2), ("t", 3, 4)], "tool string, tokens_in long, tokens_out long")
    assert json.loads(K.token_ledger(calls)) == {"t": {"in": 4, "out": 6, "calls": 2}}
    doc = K.search_document(spark.createDataFrame([(1, "fix  bug", ["a.py", "b.py"], None)], "id long, task string, files array<string>, note string"), ["task", "files", "note"])
    assert doc.first()["document"] == "fix bug a.py b.py"
    assert {(r["term"], r["n"]) for r in K.inverted_index(doc).collect()} == {("fix", 1), ("bug", 1), ("a", 1), ("b", 1), ("py", 2)}


def test_audit_bundle_and_export(spark, tmp_path):
    rows = spark.range(20).repartition(3)
    K.audit_export(rows, f"{tmp_path}/audit", b"key")
    assert K.audit_verify(spark, f"{tmp_path}/audit", b"key") == []
    assert K.audit_verify(spark, f"{tmp_path}/audit", b"other") == ["signature"]
    part = next((tmp_path / "audit" / "data").glob("part-*"))
    part.write_text(part.read_text() + "{}")
    (tmp_path / "audit" / "data" / f".{part.name}.crc").unlink(missing_ok=True)
    assert K.audit_verify(spark, f"{tmp_path}/audit", b"key") == [part.name]
    K.export_tables({"a": rows, "b": spark.range(2)}, f"{tmp_path}/out")
    assert K.import_tables(spark, f"{tmp_path}/out")["a"].count() == 20
    spark.range(3).write.mode("overwrite").parquet(f"{tmp_path}/out/b")
    with pytest.raises(ValueError):
        K.import_tables(spark, f"{tmp_path}/out")
