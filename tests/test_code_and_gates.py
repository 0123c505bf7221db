"""Rules that the registered queries meet only in part: diffs, demotion, the additive gate, monitors, folds."""

from pyspark.sql import functions as F

from tesserix.operators import codequery as Q
from tesserix.operators import retrieval as R
from tesserix.operators import text as T


def test_parse_diff():
    text = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,4 @@\n+a\n@@ -9 +12,0 @@\ndiff --git a/o.py b/n.py\nrename from o.py\nrename to n.py\ndiff --git a/d b/d\ndeleted file mode 100644\n@@ -1 +0,0 @@\ndiff --git a/e b/e\nnew file mode 100644\n@@ -0,0 +1 @@"
    assert Q.parse_diff(text) == [("x.py", "modified", None, [(3, 6), (12, 12)]), ("n.py", "renamed", "o.py", []), ("d", "deleted", None, [(1, 1)]), ("e", "added", None, [(1, 1)])]


def ranked(spark, names):
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "doc_id string, rank long")


def test_additive_gate_freezes_the_lexical_top(spark):
    got = R.additive_gate(ranked(spark, ["lex1", "lex2", "boosted"]), ranked(spark, ["boosted", "sem_only", "lex1"]), 5)
    order = got.orderBy(F.desc("score"), F.asc_nulls_last("sr")).select("doc_id").collect()
    # A hit that only the vector list has wins a tie against a lexical one.
    assert [r["doc_id"] for r in got.orderBy(F.desc("score"), F.desc("semantic_only")).collect()] == ["lex1", "sem_only", "lex2", "boosted"] and len(order) == 4


def test_fusion_weights(spark):
    lex, sem = ranked(spark, ["a", "b", "c"]), ranked(spark, ["c", "d", "a"])
    score = {r["doc_id"]: r["score"] for r in R.fuse([(lex, 1.0), (sem, 1.0)]).collect()}
    assert abs(score["a"] - (1 / 61 + 1 / 63)) < 1e-12 and abs(score["c"] - (1 / 63 + 1 / 61)) < 1e-12


def test_demotion(spark):
    def order(paths, window):
        rows = spark.createDataFrame([(0, i, p) for i, p in enumerate(paths)], "q int, pos int, path string")
        return [r["path"] for r in R.demote(rows, ["q"], "pos", F.col("path").endswith(".md"), window).orderBy("rank").collect()]

    assert order(["a.md", "b.md", "c.md", "d.md", "e.py", "f.py", "g.md", "h.rs"], 8) == ["a.md", "b.md", "e.py", "f.py", "h.rs", "c.md", "d.md", "g.md"]
    assert order(["a.md", "b.md", "c.py", "d.md", "e.md"], 2) == ["a.md", "c.py", "b.md", "d.md", "e.md"]
    assert order(["a.md", "b.md", "c.md"], 2) == ["a.md", "b.md", "c.md"]


def test_line_runs(spark):
    rows = [(1, "\n".join(["retrying connection..."] * 40)), (2, "a\na\nb"), (3, "start\n\n\n\n\n\nend"), (4, "x\nx\nx\ny\nx\nx\nx"), (5, "")]
    got = dict(T.fold_runs(spark.createDataFrame(rows, "doc_id long, t string")).collect())
    assert got == {1: "retrying connection... (line repeated 40 times)", 2: "a\na\nb", 3: "start\n\nend", 4: "x (line repeated 3 times)\ny\nx (line repeated 3 times)", 5: ""}


def test_monitors(spark):
    same = "The file src/main.py contains the handler function with error handling."
    talks = {
        1: ["I read the file and found a bug in line 42.", "I searched for similar patterns and found none.", "I edited the function to fix the null check.", "I ran the tests and they passed."],
        2: [same, same + " There is also a bug.", same + " Same handler, same file."],
        3: ["ok.", "yes."], 4: ["only one"],
        5: ["It works correctly and there is no error.", "I ran the tests.", "There was an error and the tests failed."],
        6: ["I looked at the code.", "The fix is done and complete."],
    }
    rows = [(c, i, t.lower()) for c, ts in talks.items() for i, t in enumerate(ts)]
    got = {r["conv_id"]: r for r in T.monitors(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert got[1]["loop"] < 0.5 and got[2]["loop"] >= 0.5 and got[3]["loop"] == 0 and got[4]["loop"] == 0
    assert got[5]["contradiction"] == 1 and got[1]["contradiction"] == 0 and got[6]["skip"] == 1 and got[1]["skip"] == 0


def test_formats(spark):
    f = spark.range(1).select(T.duration(F.lit(45)), T.duration(F.lit(720)), T.duration(F.lit(5400)), T.duration(F.lit(460_800)), T.token_count(F.lit(999)), T.token_count(F.lit(1234)), T.token_count(F.lit(2_500_000)), T.slug(F.lit(" !! ")))
    assert tuple(f.first()) == ("45s", "12m", "1.5h", "128h", "999", "1.2k", "2.50M", "untitled")
    assert T.prefix_query('say "Two words" foo-bar') == 'say* AND "two words" AND foo* AND bar*' and T.prefix_query("--") == '"--"'
