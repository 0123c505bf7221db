"""Steps that used to grow faster than their tables: each against its plain form."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_registry import rows_of

from tesserix.operators import codequery as Q
from tesserix.plans import registry


def test_impact_counts_search_once_a_name(spark, monkeypatch):
    sym = [(i, f"n{i % 3}", "app/a.py" if i == 4 else f"src/{i}.py", i, i + 9) for i in range(40)]
    changed = spark.createDataFrame(sym, "symbol_id long, symbol_name string, file_path string, start_line long, end_line long")
    at = [("n0", "f", "app/a.py", 3, "call_edge"), ("n1", "g", "app/a.py", 5, "call_edge"), ("n1", "f", "app/b.py", 5, "reference"), ("f", "h", "app/a.py", 8, "call_edge"), ("f", "g", "app/c.py", 1, "call_edge"), ("g", "g", "app/c.py", 1, "call_edge"), ("n2", "", "x.py", 1, "reference")]
    sites = spark.createDataFrame(at, "name string, caller string, path string, line long, via string")
    plain = {r["symbol_id"]: (r["d"], r["n"], r["f"]) for r in Q.impact(changed, sites).groupBy("symbol_id").agg(F.count_if(F.col("depth") == 1).alias("d"), F.count("*").alias("n"), F.countDistinct("path").alias("f")).collect()}
    searched, whole = [], Q.impact
    monkeypatch.setattr(Q, "impact", lambda c, *a: searched.append(c.count()) or whole(c, *a))
    got = {r["symbol_id"]: (r["direct"], r["reached"], r["files"]) for r in Q.impact_counts(changed, sites).collect()}
    assert len(got) == 40 and got == {i: plain.get(i, (0, 0, 0)) for i in range(40)}
    assert got[4] != got[7] and searched == [4]


SF = "/root/testdata/sf0.001"


def joined_rows(df):
    """Rows that the largest join of a query gives out."""
    df.collect()

    def walk(p):
        name, kids = p.getClass().getSimpleName(), p.children()
        inner = [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else [kids.apply(i) for i in range(kids.size())]
        own = p.metrics().get("numOutputRows").get().value() if "Join" in name else 0
        return max([own, *map(walk, inner)])

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Ten copies of parts and items with shifted keys: 200 keys on, a part has the name of the first."""
    top, i = str(tmp_path_factory.mktemp("copies")), spark.range(10).withColumnRenamed("id", "i")
    for name, shift in (("part", {"p_partkey": 200}), ("lineitem", {"l_partkey": 200, "l_orderkey": 1500, "l_suppkey": 10})):
        t = spark.read.parquet(f"{SF}/{name}.parquet").crossJoin(F.broadcast(i))
        t.withColumns({k: F.col(k) + n * F.col("i") for k, n in shift.items()}).drop("i").write.parquet(f"{top}/{name}.parquet")
    spark.read.parquet(f"{SF}/customer.parquet").write.parquet(f"{top}/customer.parquet")
    return top


def twin(name, top, tables=("part", "lineitem", "customer")):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{top}/{t}.parquet/*.parquet'")
    cur = con.execute(registry.ORACLES[name])
    return rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["graph_full", "findings_by_severity", "rank_of_truth"])
def test_names_are_counted_before_they_meet(spark, copies, name):
    df = registry.QUERIES[name](spark, copies)
    assert joined_rows(df) <= spark.read.parquet(f"{copies}/lineitem.parquet").count()
    assert rows_of(df.columns, df.collect()) == twin(name, copies)


def test_bursts_at_the_bound_as_in_sql(spark):
    """Rows exactly at the bound, which rounding puts on either side; all of fewer than 16 earlier rows, from where on SQL's order of sums is open."""
    import random

    from tesserix.operators import sequences as S

    draw = random.Random(7)
    rows = [(u, d, draw.randint(1, 4)) for u in range(3000) for d in range(16)]
    con = duckdb.connect()
    con.execute("CREATE TABLE d (user_id BIGINT, day BIGINT, n BIGINT)")
    con.execute("INSERT INTO d SELECT unnest($1), unnest($2), unnest($3)", [list(c) for c in zip(*rows)])
    sql = con.execute("WITH " + registry.ORACLES["burst_zscore"].partition(", z AS")[2].join(["z AS", ""])).fetchall()
    got = S.bursts(spark.createDataFrame(rows, "user_id long, day long, n long"), "user_id", "day", 2).collect()
    assert sorted(map(tuple, got)) == sorted(sql) and len(sql) > 300


def test_burst_zscore_on_more_rows(spark):
    top = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{top}/events.parquet'")
    df = registry.QUERIES["burst_zscore"](spark, top)
    cur = con.execute(registry.ORACLES["burst_zscore"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_long_texts_are_split_once(spark):
    """A text of many lines: with the split inside the lambda this did not end within 70 s."""
    import time

    from tesserix.operators import text as T

    rows = [(1, "\n".join(f"line {i // 2}  " for i in range(20_000))), (2, None), (3, ""), (4, "a\n\n\na \n a\nb")]
    d = spark.createDataFrame(rows, "doc_id long, t string")
    start = time.perf_counter()
    clean = dict(d.select("doc_id", T.clean_markdown(F.col("t"))).collect())
    apart = dict(d.select("doc_id", T.drop_adjacent_lines(F.col("t"))).collect())
    folded = dict(T.fold_runs(d).collect())
    assert time.perf_counter() - start < 30
    assert clean == {1: "\n".join(f"line {i}" for i in range(10_000)), 2: None, 3: "", 4: "a\n\n\na\nb"}
    assert apart == {1: "\n".join(f"line {i}  " for i in range(10_000)), 2: None, 3: "", 4: "a\n\n\na \n a\nb"}
    assert folded[1].count("\n") == 19_999 and folded[2] is None


def test_embedding_hashes_a_word_once(monkeypatch):
    import hashlib
    import re

    from tesserix.operators import similarity as S

    def plain(text, dim):
        out, words = [0.0] * dim, re.findall("[a-zA-Z0-9_]+", text.lower())
        joined = "_".join(words)
        for grams, weight, sign in ((words, 1.0, 4), ([joined[i : i + 3] for i in range(len(joined) - 2)], 0.25, 5)):
            for g in grams:
                d = hashlib.sha256(g.encode()).digest()
                out[int.from_bytes(d[:4], "big") % dim] += weight if d[sign] & 1 else -weight
        norm = sum(x * x for x in out) ** 0.5
        return [x / norm if norm else x for x in out]

    texts = ["", "a", "ab", "--", "The quick_brown fox, ÄÖ İstanbul 12 fox", "K9 K x" * 5, "w" * 500 + " A_b", "the fox " * 1000]
    for t in texts:
        for dim in (4, 64):
            assert S.embed(t, dim) == pytest.approx(plain(t, dim), abs=1e-12)
    calls, whole = [], S._slot
    monkeypatch.setattr(S, "_slot", lambda *a: calls.append(a) or whole(*a))
    S.embed("hound and fox " * 500, 64)
    assert len(calls) <= 3


def test_signatures_hash_a_word_once(monkeypatch):
    from tesserix.operators import similarity as S

    plain = lambda words: S._permuted(words).min(axis=0).tolist()
    small = S._Permuted(20)
    monkeypatch.setattr(S, "_seen", lambda: small)
    for words in (["a", "b"], [f"x{i}" for i in range(15)], ["a", "b", "c", "x1", "x2"], [f"y{i}" for i in range(30)], ["a", "y1"]):
        assert S.signature(words) == plain(words) and len(small.at) <= 20
    hashed, whole = [], S._permuted
    monkeypatch.setattr(S, "_permuted", lambda words: hashed.extend(words) or whole(words))
    for _ in range(5):
        S.signature(["fresh", "words", "fresh"])
    assert sorted(hashed) == ["fresh", "words"]


@pytest.mark.parametrize("name", ["join_caller_counts", "graph_topology"])
def test_tasks_hold_a_bounded_number_of_items(spark, tmp_path, name):
    """Also where keys of parts and orders come twice, suppliers are unknown and parts have no items."""
    from tesserix.shared import spread

    assert spread(spark.range(1050), "id", each=100).rdd.getNumPartitions() == 11 and spread(spark.range(0), "id").count() == 0
    tables = ("part", "lineitem", "supplier", "orders", "customer")
    for t in tables:
        d = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "lineitem":
            d = d.filter("l_partkey % 7 <> 0").withColumn("l_suppkey", F.when(F.col("l_orderkey") % 5 > 0, F.col("l_suppkey")))
        (d.union(d.limit(20)) if t in ("part", "orders") else d).write.parquet(f"{tmp_path}/{t}.parquet")
    df = registry.QUERIES[name](spark, str(tmp_path))
    assert rows_of(df.columns, df.collect()) == twin(name, tmp_path, tables)
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
