"""Fusion gates, passage ranks, demotion, packing, near-duplicates and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserix.operators import retrieval as R
from tesserix.operators import similarity as D
from tesserix.plans.base import EVENTS, events
from tesserix.plans.content import _BM, _RRF, _TERMS, lists
from tesserix.plans.registry import register
from tesserix.sources import table


@register("semantic_gate", f"""{_RRF}, g AS (SELECT coalesce(a.doc_id, l.doc_id) AS doc_id, a.rank AS lr, l.rank AS sr FROM a FULL JOIN (SELECT * FROM l WHERE rank <= 5) l ON a.doc_id = l.doc_id)
SELECT doc_id, round(CASE WHEN lr IS NOT NULL THEN 1.0 / (60 + lr) ELSE 1.0 / (60 + sr) END, 8) AS score, lr IS NULL AS semantic_only FROM g""")
def semantic_gate(spark, sf):
    """Lexical hits keep their lexical score; only what the vector list alone has among its first k gets a vector score."""
    a, v = lists(spark, sf)
    return R.additive_gate(a, v, 5).select("doc_id", F.round("score", 8).alias("score"), "semantic_only")


@register("hybrid_passages", f"""WITH {_BM}, x AS (SELECT max(bm25) AS top FROM b), q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 3), c AS (SELECT vec_id AS doc_id, list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) AS cos FROM embeddings, q)
SELECT doc_id, round(bm25 / top, 6) AS bm25_norm, round(coalesce(cos, 0), 6) AS cosine, round(0.5 * bm25 / top + 0.5 * coalesce(cos, 0), 6) AS score FROM b JOIN documents USING (doc_id) LEFT JOIN c USING (doc_id), x WHERE list_has_all([lang, source], ['en']) AND doc_id >= 20 AND (bm25 > 0 OR cos IS NOT NULL)""")
def hybrid_passages(spark, sf):
    """Lexical score over its maximum, and cosine, half each; tags and time are asked before anything is ranked."""
    docs, e = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    query = e.filter("vec_id = 3").select(F.col("embedding").alias("q"))
    cos = e.join(F.broadcast(query)).select(F.col("vec_id").alias("doc_id"), R.cosine(F.col("embedding"), F.col("q")).alias("cos"))
    b = R.bm25(docs, _TERMS)
    top = b.agg(F.max("bm25").alias("top"))
    tags = F.array("lang", "source")
    wanted = docs.filter((F.size(F.array_except(F.array(F.lit("en")), tags)) == 0) & (F.col("doc_id") >= 20)).select("doc_id")
    j = wanted.join(b, "doc_id", "left").join(cos, "doc_id", "left").filter("bm25 IS NOT NULL OR cos IS NOT NULL").join(F.broadcast(top))
    n, c = F.coalesce("bm25", F.lit(0.0)) / F.col("top"), F.coalesce("cos", F.lit(0.0))
    return j.select("doc_id", F.round(n, 6).alias("bm25_norm"), F.round(c, 6).alias("cosine"), F.round(0.5 * n + 0.5 * c, 6).alias("score"))


_SIGNALS = {"domain": 0.25, "overlap": 0.2, "history": 0.2, "files": 0.15, "vector": 0.2}


@register("playbook_scoring", """SELECT p_partkey, round(0.25 * CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END + 0.2 * (p_size % 10) / 10.0 + 0.2 * (p_partkey % 7) / 7.0 + 0.15 * CASE WHEN contains(p_name, 'ring') THEN 1 ELSE 0 END + 0.2 * (p_size % 3) / 3.0, 6) AS score,
CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_size % 4 = 0 AND p_partkey % 2 = 0 THEN 1 WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END AS tier FROM part WHERE NOT (p_size % 4 = 0 AND p_partkey % 2 = 1 AND p_partkey % 5 <> 0) ORDER BY tier, score DESC, p_partkey LIMIT 200""")
def playbook_scoring(spark, sf):
    """Weighted signals that add up to one at most, under a fixed order of tiers: proven first, then those for errors where there are errors."""
    signals = {"domain": (F.col("p_type") == "PROMO").cast("int"), "overlap": (F.col("p_size") % 10) / 10.0, "history": (F.col("p_partkey") % 7) / 7.0, "files": F.col("p_name").contains("ring").cast("int"), "vector": (F.col("p_size") % 3) / 3.0}
    score = sum((F.lit(w) * signals[k] for k, w in _SIGNALS.items()), F.lit(0.0))
    proven, for_errors, errors = F.col("p_partkey") % 5 == 0, F.col("p_size") % 4 == 0, F.col("p_partkey") % 2 == 0
    tier = F.when(proven, 0).when(for_errors & errors, 1).when(errors, 3).otherwise(2)
    p = table(spark, sf, "part").filter(proven | errors | ~for_errors)
    return p.select("p_partkey", F.round(score, 6).alias("score"), tier.alias("tier")).orderBy("tier", F.desc("score"), "p_partkey").limit(200)


@register("overflow_demotion", """WITH r AS (SELECT p_brand, p_partkey, p_type = 'PROMO' AS doc, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS pos FROM part), n AS (SELECT *, sum(CASE WHEN doc THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY pos) AS docs FROM r),
a AS (SELECT *, NOT doc OR docs <= 2 AS ok FROM n), h AS (SELECT *, ok AND sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY pos) <= 8 AS head FROM a) SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY NOT head, pos) AS rank FROM h""")
def overflow_demotion(spark, sf):
    """At most a quarter of the head's eight places go to one kind; the rest of it follows the head in its order, and nothing is dropped."""
    r = table(spark, sf, "part").withColumn("pos", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")))
    return R.demote(r, ["p_brand"], "pos", F.col("p_type") == "PROMO", 8).select("p_brand", "p_partkey", F.col("rank").cast("long").alias("rank"))


_PACK = "SELECT p_brand, p_partkey AS id, p_size AS cost, (p_partkey * 37) % 101 AS score FROM part"


@register("token_packing", f"""WITH RECURSIVE k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, id) AS i FROM ({_PACK})), r(p_brand, i, used, kept) AS (SELECT DISTINCT p_brand, 0::BIGINT, 0::BIGINT, ''::VARCHAR FROM part UNION ALL
SELECT r.p_brand, k.i, CASE WHEN used + cost <= 90 THEN used + cost ELSE used END, CASE WHEN used + cost <= 90 THEN kept || ',' || id ELSE kept END FROM r JOIN k ON k.p_brand = r.p_brand AND k.i = r.i + 1) SELECT p_brand, used, substr(kept, 2) AS kept FROM r QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY i DESC) = 1""")
def token_packing(spark, sf):
    items = table(spark, sf, "part").selectExpr("p_brand", "p_partkey AS id", "p_size AS cost", "(p_partkey * 37) % 101 AS score")
    return D.greedy_pack(items, "p_brand", 90).select("p_brand", "used", F.array_join("kept", ",").alias("kept"))


@register("knapsack_packing")
def knapsack_packing(spark, sf):
    """Of each brand's thirty first parts the choice of most value within the budget, exactly."""
    first = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    items = table(spark, sf, "part").withColumn("_r", first).filter("_r <= 30").selectExpr("p_brand", "p_partkey AS id", "CAST(p_size AS BIGINT) AS cost", "(p_partkey * 37) % 101 AS value")
    return D.best_packs(items, "p_brand", 120).select("p_brand", "value", "used", F.array_join("kept", ",").alias("kept"))


@register("relevance_chunks", """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE len(string_split(text, chr(10))) BETWEEN 2 AND 40), s AS (SELECT doc_id, i, length(x) AS cost, (contains(lower(x), 'the') OR false)::INT + contains(lower(x), 'und')::INT + contains(lower(x), 'que')::INT AS score FROM l WHERE trim(x) <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS n FROM s), r(doc_id, n, used, kept) AS (SELECT DISTINCT doc_id, 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM s UNION ALL SELECT r.doc_id, k.n, CASE WHEN used + cost <= 300 THEN used + cost ELSE used END, CASE WHEN used + cost <= 300 THEN list_append(kept, k.i) ELSE kept END FROM r JOIN k ON k.doc_id = r.doc_id AND k.n = r.n + 1),
z AS (SELECT doc_id, used, kept FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1) SELECT doc_id, used, array_to_string(list_sort(kept), ',') AS lines FROM z""")
def relevance_chunks(spark, sf):
    """Lines by how many of the terms they hold, taken under a budget of characters, given in the text's order."""
    l = table(spark, sf, "documents").filter(F.size(F.split("text", "\n")).between(2, 40)).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).filter(F.trim("x") != "")
    score = sum((F.lower("x").contains(t).cast("int") for t in ("the", "und", "que")), F.lit(0))
    items = l.select("doc_id", (F.col("i") + 1).alias("id"), F.length("x").alias("cost"), score.alias("score"))
    return D.greedy_pack(items, "doc_id", 300).select("doc_id", "used", F.array_join(F.array_sort("kept"), ",").alias("lines"))


@register("bm25_recency", f"WITH {_BM} SELECT doc_id, round(bm25, 2) AS bm25 FROM b WHERE bm25 > 0 ORDER BY round(b.bm25, 2) DESC, doc_id DESC LIMIT 30 OFFSET 10")
def bm25_recency(spark, sf):
    """Ties of the score go to the newer document."""
    return R.bm25(table(spark, sf, "documents"), _TERMS).select("doc_id", F.round("bm25", 2).alias("bm25")).orderBy(F.desc("bm25"), F.desc("doc_id")).offset(10).limit(30)


@register("hit_rates", f"""{_RRF}, k AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 8) DESC, doc_id) AS rank FROM r), t AS (SELECT lang, min(rank) AS first FROM documents LEFT JOIN k USING (doc_id) JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY lang)
SELECT lang, round(coalesce(1.0 / first, 0), 6) AS mrr, coalesce(first <= 1, false) AS hit1, coalesce(first <= 3, false) AS hit3 FROM t""")
def hit_rates(spark, sf):
    """By group: reciprocal rank of the first true result, and whether it is among the first one and three."""
    a, v = lists(spark, sf)
    k = R.ranked(R.fuse([(a, 1.0), (v, 0.5)]).select("doc_id", F.round("score", 8).alias("score")), "score", 1000)
    good = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id")
    t = good.join(k, "doc_id", "left").groupBy("lang").agg(F.min("rank").alias("first"))
    return t.select("lang", F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.coalesce(F.col("first") <= 1, F.lit(False)).alias("hit1"), F.coalesce(F.col("first") <= 3, F.lit(False)).alias("hit3"))


@register("macro_f1", f"""WITH {EVENTS}, r AS (SELECT user_id, list(k ORDER BY us, event_id) AS l FROM e GROUP BY 1), d AS (SELECT user_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:10] AS top FROM r), g AS (SELECT user_id, list(DISTINCT k) AS rel FROM e WHERE event_type = 'purchase' GROUP BY 1),
s AS (SELECT len(list_intersect(top, rel)) AS tp, len(top) AS got, len(rel) AS want FROM d JOIN g USING (user_id)) SELECT count(*) AS cases, round(avg(tp / got), 6) AS precision, round(avg(tp / want), 6) AS recall, round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (got + want) END), 6) AS f1 FROM s""")
def macro_f1(spark, sf):
    """Rankings are made distinct, then cut at ten; precision, recall and F1 of each case, averaged."""
    e = events(spark, sf)
    r = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", "k"))), lambda x: x["k"]).alias("l"))
    g = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.collect_set("k").alias("rel"))
    s = r.join(g, "user_id").select(F.slice(F.array_distinct("l"), 1, 10).alias("top"), "rel").select(F.size(F.array_intersect("top", "rel")).alias("tp"), F.size("top").alias("got"), F.size("rel").alias("want"))
    return s.agg(F.count("*").alias("cases"), F.round(F.avg(F.col("tp") / F.col("got")), 6).alias("precision"), F.round(F.avg(F.col("tp") / F.col("want")), 6).alias("recall"), F.round(F.avg(2.0 * F.col("tp") / (F.col("got") + F.col("want"))), 6).alias("f1"))


# Duplicates and embeddings


@register("near_duplicate_collapse")
def near_duplicate_collapse(spark, sf):
    """doc_id, kept: of documents whose signatures agree in four fifths of their slots the one of the least id stays."""
    docs = table(spark, sf, "documents")
    groups = D.clusters(D.similar_links(D.cut(D.signatures(docs)), 0.8))
    return docs.select("doc_id").join(groups.filter("node <> cluster").select(F.col("node").alias("doc_id"), F.lit(False).alias("kept")), "doc_id", "left").select("doc_id", F.coalesce("kept", F.lit(True)).alias("kept"))


@register("duplicate_clusters")
def duplicate_clusters(spark, sf):
    """cluster, members, stale (no member of quality), and whether its members fail so often that it is set aside."""
    groups = D.clusters(D.similar_links(D.cut(D.signatures(table(spark, sf, "documents"))), 0.8))
    g = groups.join(table(spark, sf, "labels").withColumnRenamed("doc_id", "node"), "node", "left").groupBy("cluster").agg(F.count("*").alias("members"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return g.select("cluster", "members", (F.col("good") == 0).alias("stale"), (2 * F.col("toxic") > F.col("members")).alias("set_aside"))


@register("session_epoch_dedup", f"""WITH {EVENTS}, c AS (SELECT user_id, us, event_id, k, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS epoch FROM e)
SELECT user_id, epoch::BIGINT AS epoch, sha256(CAST(k AS VARCHAR)) AS digest, min(struct_pack(u := us, i := event_id)).i AS first_id, count(*) - 1 AS hits FROM c GROUP BY 1, 2, 3""")
def session_epoch_dedup(spark, sf):
    """Content counts once a session and epoch; a reset (error) begins a new one."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    c = events(spark, sf).withColumn("epoch", F.count_if(F.col("event_type") == "error").over(w))
    return c.groupBy("user_id", "epoch", F.sha2(F.col("k").cast("string").cast("binary"), 256).alias("digest")).agg(F.min_by("event_id", F.struct("us", "event_id")).alias("first_id"), (F.count("*") - 1).alias("hits"))


@register("version_deltas")
def version_deltas(spark, sf):
    """Turns of a conversation as versions of one text that grows: each as a diff to the one before where that is shorter."""
    c = table(spark, sf, "conversations")
    grown = F.array_join(F.collect_list("text").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-5, 0)), "\n")
    return D.deltas(c.select(F.col("conv_id").alias("key"), F.col("turn").alias("version"), grown.alias("text")))


@register("hash_embeddings")
def hash_embeddings(spark, sf):
    return D.embeddings(table(spark, sf, "documents"))


@register("embedding_cache", "WITH d AS (SELECT sha256(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1) SELECT digest, doc_id FROM d WHERE digest NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def embedding_cache(spark, sf):
    """What is still to be embedded: one row a new text, for one model and dimension."""
    docs = table(spark, sf, "documents")
    cache = docs.filter("doc_id % 3 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.lit("hash").alias("model"), F.lit(64).alias("dim"))
    return D.to_embed(docs, cache.filter("model = 'hash' AND dim = 64")).select("digest", "doc_id")
