"""Text, similarity, retrieval, graph and stream queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserix.operators import graph as G
from tesserix.operators import retrieval as R
from tesserix.operators import similarity as D
from tesserix.operators import text as T
from tesserix.plans.base import EVENTS, HOPS, hops
from tesserix.plans.registry import register
from tesserix.shared import shared_dir, spread
from tesserix.sources import table
from tesserix.streaming import refold


def _quote(s: str) -> str:
    return s.replace("'", "''")


def _chain_sql(expr: str, steps) -> str:
    for pattern, with_ in steps:
        expr = f"regexp_replace({expr}, '{_quote(pattern)}', '{_quote(with_)}', 'g')"
    return expr


@register("text_redaction", f"SELECT doc_id, sha256({_chain_sql('text', T.REDACTIONS)}) AS digest, {_chain_sql('text', T.REDACTIONS)} <> text AS changed FROM documents")
def text_redaction(spark, sf):
    r = T.redact(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(r.cast("binary"), 256).alias("digest"), (r != F.col("text")).alias("changed"))


@register("text_injection_flag", f"SELECT conv_id, turn, regexp_matches(text, '(?i){'|'.join(T.INJECTIONS)}') AS injected, contains(text, '$(') OR contains(text, '`') OR contains(text, '&&') AS shell FROM conversations")
def text_injection_flag(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.any_of(t, T.INJECTIONS).alias("injected"), (t.contains("$(") | t.contains("`") | t.contains("&&")).alias("shell"))


@register("url_tracking_strip", f"SELECT page_id, {T.tracking_sql("url")} AS url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def url_tracking_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_tracking(F.col("url")).alias("url"), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"))


@register("html_strip", f"SELECT page_id, sha256({_chain_sql('html', T.HTML_STEPS)}) AS digest, length({_chain_sql('html', T.HTML_STEPS)}) AS chars FROM pages")
def html_strip(spark, sf):
    s = T.strip_html(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.sha2(s.cast("binary"), 256).alias("digest"), F.length(s).cast("long").alias("chars"))


@register("html_markdown")
def html_markdown(spark, sf):
    return T.pages_to_markdown(table(spark, sf, "pages"))


@register("text_plain", f"SELECT doc_id, sha256(trim({_chain_sql('text', T.PLAIN_STEPS)})) AS digest, length(text) // 4 AS tokens FROM documents")
def text_plain(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.plain(F.col("text")).cast("binary"), 256).alias("digest"), F.floor(F.length("text") / 4).alias("tokens"))


@register("text_adjacent_lines", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), k AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l)
SELECT doc_id, sha256(string_agg(x, chr(10) ORDER BY i)) AS digest FROM k WHERE trim(x) = '' OR p IS NULL OR x <> p GROUP BY doc_id""")
def text_adjacent_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.drop_adjacent_lines(F.col("text")).cast("binary"), 256).alias("digest"))


@register("text_operation_key", """SELECT doc_id, substr(sha1(lower(lang) || '::' || trim(regexp_replace(regexp_replace(lower(source), '[0-9]+', 'N', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))), 1, 16) AS key FROM documents""")
def text_operation_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.operation_key(F.col("lang"), F.col("source")).alias("key"))


@register("text_chunks", "SELECT doc_id, i AS chunk, length(string_split(text, chr(10))[i]) AS chars FROM documents, (SELECT unnest(range(1, (SELECT max(len(string_split(text, chr(10)))) + 1 FROM documents))) AS i) WHERE i <= len(string_split(text, chr(10))) AND trim(string_split(text, chr(10))[i]) <> ''")
def text_chunks(spark, sf):
    x = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    return x.filter(F.trim("x") != "").select("doc_id", (F.col("i") + 1).cast("long").alias("chunk"), F.length("x").cast("long").alias("chars"))


@register("dedup_exact", "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS keeper FROM documents GROUP BY 1")
def dedup_exact(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("keeper"))


@register("minhash_signatures")
def minhash_signatures(spark, sf):
    """doc_id, signature: 128 minima of affine hashes of the words of a document."""
    return D.signatures(table(spark, sf, "documents"))


@register("vector_top_k", """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT query_id, vec_id, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])), 6) AS score
FROM embeddings, q WHERE vec_id <> query_id ORDER BY score DESC, vec_id LIMIT 20""")
def vector_top_k(spark, sf):
    """One query, the row of the least id; vector_top_k_queries takes the whole query set."""
    e = table(spark, sf, "embeddings")
    return R.nearest(e, e.orderBy("vec_id").limit(1), 20)


@register("vector_top_k_queries", """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])), 6) AS score
FROM embeddings, q WHERE vec_id <> query_id)
SELECT query_id, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""")
def vector_top_k_queries(spark, sf):
    """Every row whose id is divisible by 100 as a query against all rows."""
    e = table(spark, sf, "embeddings")
    return R.nearest(e, e.filter("vec_id % 100 = 0"), 20)


_TERMS = ["the", "token", "worthless", "was"]
_TOK = "regexp_extract_all(lower(text), '[a-z0-9_]+')"
_BM = f"""d AS (SELECT doc_id, {_TOK} AS t FROM documents), f AS (SELECT doc_id, len(t) AS l, {", ".join(f"len(list_filter(t, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(_TERMS))} FROM d),
s AS (SELECT count(*) AS n, avg(l) AS al, {", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(_TERMS)))} FROM f),
b AS (SELECT doc_id, {" + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * l / al))" for i in range(len(_TERMS)))} AS bm25 FROM f, s)"""


@register("bm25_search", f"WITH {_BM} SELECT doc_id, round(bm25, 6) AS bm25 FROM b WHERE bm25 > 0 ORDER BY b.bm25 DESC, doc_id LIMIT 50")
def bm25_search(spark, sf):
    return R.bm25(table(spark, sf, "documents"), _TERMS).orderBy(F.desc("bm25"), "doc_id").limit(50).select("doc_id", F.round("bm25", 6).alias("bm25"))


_RRF = f"""WITH {_BM}, a AS (SELECT doc_id, row_number() OVER (ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM b WHERE bm25 > 0 ORDER BY rank LIMIT 100),
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), c AS (SELECT vec_id AS doc_id, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])), 6) AS score FROM embeddings, q WHERE vec_id <> 0),
l AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c ORDER BY rank LIMIT 100),
u AS (SELECT doc_id, 1.0 / (60 + rank) AS s FROM a UNION ALL SELECT doc_id, 0.5 / (60 + rank) FROM l), r AS (SELECT doc_id, sum(s) AS score FROM u GROUP BY 1)"""


def lists(spark, sf):
    """(doc_id, rank) of the lexical and of the vector list; a vector belongs to the document of its id, and vector 0 is the query."""
    docs, e = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    a = R.ranked(R.bm25(docs, _TERMS).select("doc_id", F.round("bm25", 6).alias("bm25")), "bm25", 100)
    near = R.nearest(e, e.filter("vec_id = 0"), 100).select(F.col("vec_id").alias("doc_id"), "score")
    return a, R.ranked(near, "score", 100)


def _fused(spark, sf):
    a, v = lists(spark, sf)
    return R.fuse([(a, 1.0), (v, 0.5)])


@register("rank_fusion", f"{_RRF} SELECT doc_id, round(score, 8) AS score FROM r")
def rank_fusion(spark, sf):
    return _fused(spark, sf).select("doc_id", F.round("score", 8).alias("score"))


@register("retrieval_metrics", f"""{_RRF}, k AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 8) DESC, doc_id) AS rank FROM r), g AS (SELECT doc_id FROM labels WHERE quality = 1), h AS (SELECT k.*, g.doc_id IS NOT NULL AS hit FROM k LEFT JOIN g ON k.doc_id = g.doc_id)
SELECT round(count(*) FILTER (hit AND rank <= 20) / 20.0, 6) AS p_at_20, round(count(*) FILTER (hit AND rank <= 20) / (SELECT count(*) FROM g), 8) AS r_at_20, round(coalesce(1.0 / min(rank) FILTER (hit), 0), 6) AS mrr FROM h""")
def retrieval_metrics(spark, sf):
    k = R.ranked(_fused(spark, sf).select("doc_id", F.round("score", 8).alias("score")), "score", 1000)
    gold = table(spark, sf, "labels").filter("quality = 1").select("doc_id", F.lit(True).alias("hit"))
    h = k.join(gold, "doc_id", "left")
    top = F.count_if(F.col("hit") & (F.col("rank") <= 20))
    m = h.agg(top.alias("t"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first")).join(F.broadcast(gold.agg(F.count("*").alias("g"))))
    return m.select(F.round(F.col("t") / F.lit(20.0), 6).alias("p_at_20"), F.round(F.col("t") / F.col("g"), 8).alias("r_at_20"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


# Graphs


@register("graph_coupling", f"""WITH {HOPS}, d AS (SELECT DISTINCT src, dst FROM hop), a AS (SELECT dst AS node, count(*) AS ca FROM d GROUP BY 1), c AS (SELECT src AS node, count(*) AS ce FROM d GROUP BY 1)
SELECT coalesce(a.node, c.node) AS node, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, round(coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)), 4) AS instability FROM a FULL JOIN c ON a.node = c.node""")
def graph_coupling(spark, sf):
    return G.coupling(hops(spark, sf))


@register("graph_blast_radius", f"""WITH RECURSIVE {HOPS}, d AS (SELECT DISTINCT src, dst FROM hop), r(node, depth) AS (SELECT node, 0 FROM (SELECT min(dst) AS node FROM d) WHERE node IS NOT NULL UNION SELECT d.src, r.depth + 1 FROM r JOIN d ON d.dst = r.node WHERE r.depth < (SELECT count(*) FROM d))
SELECT node, min(depth)::BIGINT AS depth, min(depth) = 1 AS direct FROM r GROUP BY node""")
def graph_blast_radius(spark, sf):
    """Everything that reaches the least target of an edge, with its distance."""
    e = hops(spark, sf)
    seed = e.agg(F.min("dst").alias("node")).filter("node IS NOT NULL")
    return G.reach(G.reverse(e), seed).select("node", F.col("depth").cast("long").alias("depth"), (F.col("depth") == 1).alias("direct"))


@register("graph_dead_nodes", f"WITH {HOPS} SELECT DISTINCT src AS node FROM hop WHERE src NOT IN (SELECT dst FROM hop)")
def graph_dead_nodes(spark, sf):
    e = hops(spark, sf)
    return e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")), "node", "left_anti")


@register("graph_cycles", f"""WITH RECURSIVE {HOPS}, d AS (SELECT DISTINCT src, dst FROM hop), r(a, b) AS (SELECT src, dst FROM d UNION SELECT r.a, d.dst FROM r JOIN d ON r.b = d.src),
n AS (SELECT src AS node FROM d UNION SELECT dst FROM d) SELECT node, coalesce(least(node, (SELECT min(x.b) FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a = node)), node) AS component FROM n""")
def graph_cycles(spark, sf):
    return G.strong_components(hops(spark, sf))


@register("graph_levels")
def graph_levels(spark, sf):
    return G.levels(hops(spark, sf))


@register("graph_pagerank")
def graph_pagerank(spark, sf):
    return G.pagerank(hops(spark, sf))


@register("graph_neighbourhood", f"""WITH {HOPS}, d AS (SELECT DISTINCT src, dst FROM hop), a AS (SELECT src AS node, dst AS other FROM d UNION SELECT dst, src FROM d) SELECT node, count(*) AS degree, sum(other)::BIGINT AS check_sum FROM a GROUP BY 1""")
def graph_neighbourhood(spark, sf):
    e = hops(spark, sf)
    return e.union(G.reverse(e)).distinct().groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("dst").alias("check_sum"))


@register("graph_topology", """SELECT s_nationkey AS src, c_nationkey AS dst, count(DISTINCT o_orderkey) AS edges FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2""")
def graph_topology(spark, sf):
    """An order once a pair of nations; items and orders meet in partitions of a bounded number of items."""
    s, li, o, c = (table(spark, sf, t) for t in ("supplier", "lineitem", "orders", "customer"))
    n = li.count()
    sold = spread(li.join(s, li["l_suppkey"] == s["s_suppkey"]).select("l_orderkey", "s_nationkey"), "l_orderkey", rows=n).distinct()
    bought = spread(o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_nationkey"), "o_orderkey", rows=n).distinct()
    j = sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).filter("s_nationkey <> c_nationkey")
    return j.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").alias("edges"))


# Streams


@register("stream_refold", f"WITH {EVENTS} SELECT user_id, day, count(*) AS n, sum(cents)::BIGINT AS cents FROM e GROUP BY 1, 2")
def stream_refold(spark, sf):
    """The event files as a stream; the folded table equals the batch query."""
    top = f"{shared_dir(spark)}/refold-{uuid.uuid4().hex}"
    # A pattern, as a stream's source is a folder or a pattern, and the table may be one file.
    return refold.stream_fold(spark, f"{sf}/events.parque[t]", f"{top}/table", f"{top}/progress")
