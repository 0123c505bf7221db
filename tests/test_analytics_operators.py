"""Operators that SQL can't check, and inputs that must be refused."""

import random

import pytest

from tesserix.operators import graph, predicates, similarity, text
from tesserix.plans.relational import ORDERS
from tesserix.streaming import refold

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "where",
    [{"nope": 1}, {"o_orderkey; DROP TABLE x": 1}, {"o_orderkey_in": []}, {"o_orderkey_in": 3}, {"o_orderstatus_gte": "F"}, {"o_totalprice_gt": "1"}, {"o_orderkey": [1]}, {"o_orderstatus_regex": "("}, {"o_orderstatus_regex": "a" * 600}, {"o_orderkey_like": "1%"}, {"o_orderkey": None}],
)
def test_bad_predicates_are_refused(spark, where):
    with pytest.raises(predicates.QueryError):
        predicates.select_where(spark.range(1), ORDERS, where)


def test_exact_field_names_win(spark):
    spec = predicates.Select({"x": "number", "x_in": "number"}, {})
    assert predicates.split_key("x_in", spec) == ("x_in", "") and predicates.split_key("x_gte", spec) == ("x", "_gte")
    df = spark.createDataFrame([(1, 5), (2, 6)], "x long, x_in long")
    assert predicates.select_where(df, spec, {"x_in": 6}).count() == 1


def test_like_is_ascii_and_has_no_escape(spark):
    spec = predicates.Select({"s": "text"}, {})
    df = spark.createDataFrame([("AbC",), ("a%c",), ("ÉX",), ("éX",), ("a\nc",), ("abcd",)], "s string")
    got = lambda p: {r["s"] for r in predicates.select_where(df, spec, {"s_like": p}).collect()}
    assert got("a_c") == {"AbC", "a%c", "a\nc"} and got("A%C") == {"AbC", "a%c", "a\nc"}
    assert got("Éx") == {"ÉX"} and got("a.c") == set() and got("%b%") == {"AbC", "abcd"}


@pytest.mark.parametrize("bad", ["DELETE FROM t", "drop table t", "SELECT 1; SELECT 2", "/* x */ DROP TABLE t", "-- c\nDROP TABLE t", "SET a=b", "CACHE TABLE t", "FROM t INSERT INTO u SELECT *", "INSERT INTO t VALUES (1)", "CREATE VIEW v AS SELECT 1", "nonsense"])
def test_sql_guard_refuses(spark, bad):
    with pytest.raises(predicates.QueryError):
        predicates.read_only(spark, bad)


def test_sql_limit_views_and_repair(spark):
    assert predicates.auto_limit(spark, "SELECT 1 LIMIT 3", 5) == "SELECT 1 LIMIT 3"
    assert spark.sql(predicates.auto_limit(spark, "SELECT * FROM range(9) -- limit 5", 2)).count() == 2
    assert spark.sql(predicates.auto_limit(spark, "SELECT 1 UNION SELECT 2;", 1)).count() == 1
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("orders")
    got = predicates.passthrough(spark, "SELECT count(*) AS n FROM orders", {"orders": spark.range(7)}, 10)
    assert got.first()["n"] == 7 and spark.table("orders").columns == ["a"]
    spark.catalog.dropTempView("orders")
    assert predicates.repair_column("o_ordrkey", ["o_orderkey", "o_custkey"]) == "o_orderkey"
    assert predicates.repair_column("zzz", ["o_orderkey"]) is None
    with pytest.raises(predicates.QueryError):
        predicates.batch(spark, {"a": "SELECT 1", "b": "DROP TABLE t"}, {}, 5)


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_strong_components_against_brute_force(spark):
    r = random.Random(3)
    pairs = [(r.randrange(25), r.randrange(25)) for _ in range(40)]
    reach = {a: {a} for p in pairs for a in p}
    for _ in reach:
        for a, b in pairs:
            for x in reach:
                if a in reach[x]:
                    reach[x].add(b)
    want = {x: min(y for y in reach[x] if x in reach[y]) for x in reach}
    assert {n: c for n, c in graph.strong_components(edges_of(spark, pairs)).collect()} == want


def test_levels_and_reach(spark):
    e = edges_of(spark, [(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (5, 6)])
    assert dict(graph.levels(e).collect()) == {1: 0, 2: 1, 3: 2, 4: None, 5: None, 6: None}
    seeds = spark.createDataFrame([(1,)], "node long")
    assert dict(graph.reach(e, seeds).collect()) == {1: 0, 2: 1, 3: 1}
    assert dict(graph.reach(e, seeds, 0).collect()) == {1: 0}


def test_pagerank_against_power_iteration(spark):
    pairs = [(1, 2), (1, 2), (2, 3), (3, 1), (1, 4)]
    got = dict(graph.pagerank(edges_of(spark, pairs), tol=1e-10).collect())
    share = {1: {2: 2 / 3, 4: 1 / 3}, 2: {3: 1.0}, 3: {1: 1.0}, 4: {}}
    p = dict.fromkeys(share, 0.25)
    for _ in range(200):
        lost = p[4]
        p = {n: 0.15 / 4 + 0.85 * lost / 4 + 0.85 * sum(p[m] * out.get(n, 0) for m, out in share.items()) for n in share}
    assert all(abs(got[n] - p[n]) < 1e-6 for n in p) and abs(sum(got.values()) - 1) < 1e-6


def test_empty_graph(spark):
    e = edges_of(spark, [])
    assert graph.strong_components(e).count() == graph.levels(e).count() == graph.coupling(e).count() == graph.pagerank(e).count() == 0


def test_minhash_estimates_jaccard():
    minhash = similarity.signature
    a, b = [f"w{i}" for i in range(200)], [f"w{i}" for i in range(100, 300)]
    same = sum(x == y for x, y in zip(minhash(a), minhash(b))) / 128
    assert abs(same - 1 / 3) < 0.13 and minhash(a) == minhash(list(reversed(a)))


def test_markdown():
    md = text.to_markdown("<script>x</script><h2>T</h2><p>a <a href='/u'>l</a></p><ul><li>i</li></ul><pre>c\n d</pre>")
    assert md == "## T\n\na [l](/u)\n\n- i\n\n```\nc\n d\n```"


def test_stream_equals_batch_for_late_files(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    for k, part in enumerate(e.randomSplit([0.3, 0.3, 0.4], 1)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    got = refold.stream_fold(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/ck")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, refold.day_buckets(e).collect()))


def test_a_later_version_replaces_a_session(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    half = e.filter("event_id % 2 = 0")
    for name, rows, session, version in (("a", half, "s", 1), ("b", e, "s", 2), ("c", half, "t", 7), ("d", e.limit(5), "t", 3)):
        rows.selectExpr("*", f"'{session}' AS session", f"{version}L AS version").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    got = refold.stream_fold_sessions(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/ck")
    want = refold.day_buckets(e.selectExpr("*", "'s' AS session"), "session").union(refold.day_buckets(half.selectExpr("*", "'t' AS session"), "session"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
