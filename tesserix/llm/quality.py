"""Quality rules: a table of thresholds compiled into one Spark projection, no user functions.

Every metric is a Column over three arrays that are built once a row (words, lines, hashes of
five-word windows) and bound by lambdas. RULES names a metric, a lower and an upper bound;
the verdict is the conjunction of the bounds, and failed_rules lists those that don't hold.

Repeated windows are found by sorting half a hash and the position of each window of the one text as one number. Those that
share half a hash are sorted again by their words, so a hash collision neither adds nor hides a hit.

Defined results: a null or empty text has no words and fails; rows that repeat are judged
alone; an empty table gives no rows; extra columns are ignored by assess() and kept by
keep_clean(). The cost of a text is n log n in its words, whatever it repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserix.llm.common import SPACES, let, words

STOP_WORDS = tuple(
    "the of and to in is that for it with as was on be by this are from at an or a he"
    " le la les de des et en un une que qui pour par sur au est dans il ou du"
    " der die das und ist mit von zu den dem ein eine nicht sich auf im auch es"
    " el los las y se por con para una del lo su como".split()
)
WINDOW = 5

#: metric, least, most (None: no bound), words a text needs for the rule to say anything.
RULES: tuple[tuple[str, float | None, float | None, int], ...] = (
    ("mean_word_chars", 2.0, 14.0, 1),
    ("symbol_ratio", None, 0.10, 1),
    ("shout_ratio", None, 0.20, 1),
    ("upper_ratio", None, 0.50, 1),
    ("stop_word_ratio", 0.02, None, 40),
    ("dup_line_ratio", None, 0.50, 1),
)


def _repeated_words(w: Column, n: int = WINDOW) -> Column:
    """Words inside n-word windows that occur twice or more, first occurrence included."""

    def covered(at: Column) -> Column:
        """at: sorted positions (from 1). Each covers up to the next one, n words at most."""
        return F.aggregate(
            at, F.struct(F.lit(0).alias("sum"), F.lit(-n).alias("last")),
            lambda s, x: F.struct((s["sum"] + F.least(F.lit(n), x - s["last"])).alias("sum"), x.alias("last")),
            lambda s: s["sum"],
        )

    def beside(s: Column, same: Callable[[Column, Column], Column]) -> Column:
        """The members of a sorted array that are the same as a neighbour; past either end there is none."""
        return F.filter(s, lambda x, i: F.coalesce((i > 0) & same(x, F.get(s, F.greatest(i - 1, F.lit(0)))), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)))

    def windows(h: Column) -> Column:
        """A window's hash in the upper half of a number, its position (from 0) in the lower."""
        return F.transform(F.slice(h, 1, F.size(h) - n + 1), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)]).bitwiseAND(F.lit(-1 << 32)).bitwiseOR(i.cast("long")))

    def exact(maybe: Column) -> Column:
        """Positions (from 1) of the windows that are equal word by word, of those that share half a hash."""
        spelled = F.transform(maybe, lambda x: let(x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int") + 1, lambda p: F.struct(F.slice(w, p, n).alias("g"), p.alias("p"))))
        return let(F.sort_array(spelled), lambda s: F.sort_array(F.transform(beside(s, lambda a, b: a["g"] == b["g"]), lambda x: x["p"])))

    def count(packed: Column) -> Column:
        maybe = beside(packed, lambda a, b: F.shiftright(a, 32) == F.shiftright(b, 32))
        return let(maybe, lambda m: F.when(F.size(m) == 0, F.lit(0)).otherwise(covered(exact(m))))

    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) < n + 1, F.lit(0)).otherwise(let(hashed, lambda h: let(F.sort_array(windows(h)), count))).cast("long")


def measures(text: Column) -> Column:
    """A struct of counts of one text."""
    body = F.coalesce(text, F.lit(""))

    def of(w: Column, lines: Column, marks: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(marks, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeated_words(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.length(F.regexp_replace(marks, r"[^!?]+", "")).cast("long").alias("n_shouts"),
            F.length(F.regexp_replace(marks, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # What the three character counts look at, taken out of the text in one pass.
    marks = F.regexp_replace(body, r"[^#*$%&|<>!?\p{Lu}]+", "")
    return let(words(text), lambda w: let(lines, lambda x: let(marks, lambda m: of(w, x, m))))


def ratios(m: Column) -> dict[str, Column]:
    n = F.greatest(m["n_words"], F.lit(1))
    return {
        "mean_word_chars": m["word_chars"] / n,
        "symbol_ratio": m["n_symbols"] / n,
        "shout_ratio": m["n_shouts"] / n,
        "upper_ratio": m["n_upper"] / F.greatest(m["word_chars"], F.lit(1)),
        "stop_word_ratio": m["n_stop_words"] / n,
        "dup_line_ratio": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
    }


def compile_rules(m: Column, rules: tuple = RULES) -> Column:
    """Array of the names of the rules that don't hold."""
    have = ratios(m)
    tests = []
    for name, least, most, n_words in rules:
        bad = F.lit(False)
        bad = bad if least is None else bad | (have[name] < least)
        bad = bad if most is None else bad | (have[name] > most)
        tests.append(F.when(bad & (m["n_words"] >= n_words), F.lit(name)))
    return F.array_compact(F.array(*tests))


def _base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def assess(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """One row per document: counts, base_failed, failed_rules, kept."""
    m = F.col("_m")
    df = docs.select("doc_id", measures(F.col("text")).alias("_m"))
    out = df.select("doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", "_m.n_repeat_words", _base_failed(m).alias("base_failed"), compile_rules(m, rules).alias("failed_rules"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_clean(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """The documents that pass, columns unchanged.

    The verdict is one expression that binds the counts once: a filter on a counted column would be pushed below
    the projection and count anew for every rule.
    """
    return docs.filter(let(measures(F.col("text")), lambda m: ~_base_failed(m) & (F.size(compile_rules(m, rules)) == 0)))
