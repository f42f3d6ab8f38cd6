"""Vector, lexical and fusion queries, and the flagship."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.operators import containment, fusion, graph, postings, vector
from quillgraph.plans import bindings as B
from quillgraph.plans.registry import query
from quillgraph.session import shared_folder, table

_COS = "list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"
_TOP = f"SELECT q.vec_id AS query_id, c.vec_id AS id, {_COS} AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, c.vec_id) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0"
_IDF = f"SELECT entity, count(DISTINCT hyperedge) AS df, round(ln((SELECT count(DISTINCT hyperedge) FROM ({B.INCIDENCE}))::DOUBLE / (count(DISTINCT hyperedge) + 1)) + 1.0, 4) AS idf_weight FROM ({B.INCIDENCE}) GROUP BY entity"
_GRAPH = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item) - 1 AS rank FROM (
    SELECT q.query_id, i.hyperedge - 1 AS item, round(sum(i.weight * w.idf_weight), 4) AS s FROM (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0) q
    JOIN ({B.INCIDENCE}) i ON i.entity % 97 * 20 = q.query_id JOIN ({_IDF}) w USING (entity) GROUP BY ALL) QUALIFY rank < 60"""


def _graph_stream(spark, d):
    """Hyperedges of a query's entities, scored by weight and rarity of what they share."""
    inc = B.incidence(spark, d)
    q = B.queries(spark, d).select("query_id")
    near = inc.withColumn("query_id", F.col("entity") % 97 * 20).join(q, "query_id").join(graph.idf(inc), "entity")
    by = near.groupBy("query_id", (F.col("hyperedge") - 1).alias("item")).agg(F.round(F.sum(F.col("weight") * F.col("idf_weight")), 4).alias("s"))
    line = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "item")
    return by.withColumn("rank", F.row_number().over(line) - 1).filter("rank < 60")


@query(f"""WITH v AS (SELECT query_id, id AS item, rank - 1 AS rank FROM ({_TOP}) WHERE rank <= 60), g AS ({_GRAPH}),
    f AS (SELECT query_id, item, sum(p) AS s, count(*) AS n FROM (SELECT query_id, item, 0.5 / (60 + rank + 1) AS p FROM v UNION ALL SELECT query_id, item, 0.5 / (60 + rank + 1) FROM g) GROUP BY ALL)
    SELECT query_id, item, round(CASE WHEN n = 2 THEN s * 1.2 ELSE s END, 4) AS coherence FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(CASE WHEN n = 2 THEN s * 1.2 ELSE s END, 4) DESC, s DESC, item) <= 60""")
def hybrid_query(spark, d):
    """The flagship: vector and graph streams of a batch of queries, fused by weighted ranks."""
    found = vector.top_k(B.queries(spark, d), B.vectors(spark, d), 60).select("query_id", F.col("id").alias("item"), (F.col("rank") - 1).alias("rank"))
    return fusion.weighted_fusion(found, _graph_stream(spark, d).select("query_id", "item", "rank")).drop("rank")


@query(f"SELECT query_id, id, round(sim, 5) AS similarity, rank FROM ({_TOP}) WHERE rank <= 10")
def vector_top_k(spark, d):
    return vector.top_k(B.queries(spark, d), B.vectors(spark, d), 10).withColumn("similarity", F.round("similarity", 5)).withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT query_id, id, round(sim, 5) AS similarity FROM ({_TOP}) WHERE sim >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) <= 8")
def vector_threshold(spark, d):
    return vector.top_k(B.queries(spark, d), B.vectors(spark, d), 8, least=0.2).select("query_id", "id", F.round("similarity", 5).alias("similarity"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id")
def cosine_neighbours(spark, d):
    e = B.vectors(spark, d)
    left = e.select(F.col("id").alias("a"), F.col("vector").alias("va"), (F.col("id") + 1).alias("b"))
    return left.join(e.select(F.col("id").alias("b"), F.col("vector").alias("vb")), "b").select("a", "b", F.round(vector.cosine("va", "vb"), 5).alias("cosine"))


@query("""SELECT vec_id, round(list_min(e), 6) AS lo, round(list_max(e), 6) AS hi, list_max(list_transform(e, lambda x: abs(round_even((x - list_min(e)) * 255 / (list_max(e) - list_min(e)), 0) * (list_max(e) - list_min(e)) / 255 + list_min(e) - x))) <= (list_max(e) - list_min(e)) / 510 + 1e-9 AS within
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def quantise_round_trip(spark, d):
    e = B.vectors(spark, d).withColumn("packed", vector.quantise("vector"))
    error = F.array_max(F.zip_with(vector.dequantise("packed"), "vector", lambda x, y: F.abs(x - y.cast("double"))))
    return e.select(F.col("id").alias("vec_id"), F.round("packed.lo", 6).alias("lo"), F.round("packed.hi", 6).alias("hi"), (error <= (F.col("packed.hi") - F.col("packed.lo")) / 510 + 1e-9).alias("within"))


@query("""WITH c AS (SELECT vec_id, e, list_min(e) AS lo, list_max(e) AS hi FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
    k AS (SELECT vec_id, list_transform(e, lambda x: round_even((x - lo) * 255 / (hi - lo), 0) * (hi - lo) / 255 + lo) AS e FROM c),
    p AS (SELECT q.vec_id AS query_id, k.vec_id AS key, list_cosine_similarity(q.embedding::DOUBLE[], k.e) AS s FROM embeddings q JOIN k ON q.vec_id % 20 = 0)
    SELECT query_id, CASE WHEN s > 0.95 THEN key END AS hit, round(s, 4) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) = 1""")
def semantic_cache(spark, d):
    e = B.vectors(spark, d)
    cache = e.select(F.lit("hybrid").alias("mode"), F.col("id").alias("key"), vector.quantise("vector").alias("packed"))
    q = e.filter("id % 20 = 0").select(F.lit("hybrid").alias("mode"), F.col("id").alias("query_id"), "vector")
    return vector.cache_lookup(q, cache).withColumn("similarity", F.round("similarity", 4))


@query("SELECT b.item_id, a.key FROM (SELECT md5(text) AS h, item_id FROM benchmark) b JOIN (SELECT md5(text) AS h, min(item_id) AS key FROM benchmark WHERE item_id % 2 = 0 GROUP BY 1) a USING (h)")
def exact_cache(spark, d):
    b = table(spark, d, "benchmark").withColumn("h", F.md5("text"))
    return b.join(b.filter("item_id % 2 = 0").groupBy("h").agg(F.min("item_id").alias("key")), "h").select("item_id", "key")


_BM25 = """WITH docs AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM docs),
    tf AS (SELECT doc_id, len(t) AS l, u.term, count(*) AS tf FROM docs, unnest(t) AS u(term) GROUP BY ALL), df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf, any_value(a) AS a FROM tf, st GROUP BY term, n),
    w AS (SELECT term, a, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM df) ELSE idf END AS idf FROM df),
    q AS (SELECT item_id AS query_id, u.term FROM benchmark, unnest(string_split(text, ' ')) AS u(term) WHERE item_id % 20 = 0)
    SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * l / a))) AS score FROM q JOIN w USING (term) JOIN tf USING (term) GROUP BY ALL"""


def _bm25(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("tokens"))
    asked = table(spark, d, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.split("text", " ").alias("tokens"))
    return fusion.bm25(docs, asked)


@query(f"SELECT query_id, doc_id, round(score, 4) AS score FROM ({_BM25}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 50")
def bm25_top(spark, d):
    line = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "doc_id")
    return _bm25(spark, d).withColumn("_r", F.row_number().over(line)).filter("_r <= 50").select("query_id", "doc_id", F.round("score", 4).alias("score"))


_KEPT = "(SELECT * FROM documents WHERE source IS NULL OR source <> 'src1')"


@query(f"SELECT query_id, doc_id, round(score, 4) AS score FROM ({_BM25.replace('documents', _KEPT)})")
def postings_scores(spark, d):
    """BM25 from a stored index that is built in two batches and loses the documents of a source."""
    index = postings.Postings(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    docs = table(spark, d, "documents").select("doc_id", "source", F.split("text", " ").alias("tokens"))
    early = F.coalesce(F.col("source") < "src2", F.lit(False))
    index.add(docs.filter(early))
    index.add(docs.filter(~early))
    index.remove(docs.filter("source = 'src1'"))
    asked = table(spark, d, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.split("text", " ").alias("tokens"))
    return index.scores(asked).withColumn("score", F.round("score", 4))


@query("""WITH a AS (SELECT vec_id AS item, row_number() OVER (ORDER BY label, vec_id) - 1 AS rank FROM embeddings QUALIFY rank < 50), b AS (SELECT vec_id AS item, row_number() OVER (ORDER BY label DESC, vec_id) - 1 AS rank FROM embeddings WHERE vec_id % 3 = 0 QUALIFY rank < 50)
    SELECT item, round(sum(1.0 / (60 + rank + 1)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY item""")
def rrf(spark, d):
    e = B.vectors(spark, d)
    a = e.orderBy("label", "id").limit(50).withColumn("rank", F.row_number().over(Window.orderBy("label", "id")) - 1)
    b = e.filter("id % 3 = 0").orderBy(F.col("label").desc(), "id").limit(50).withColumn("rank", F.row_number().over(Window.orderBy(F.col("label").desc(), "id")) - 1)
    both = a.unionByName(b).select(F.lit(0).alias("query_id"), F.col("id").alias("item"), "rank")
    return fusion.reciprocal_ranks(both).select("item", F.round("score", 6).alias("score"))


@query("""WITH f AS (SELECT o_custkey AS query_id, o_orderkey AS item, o_totalprice AS score FROM orders WHERE o_orderpriority LIKE '1%'), s AS (SELECT o_custkey AS query_id, o_orderkey AS item, o_totalprice AS score FROM orders WHERE o_orderstatus = 'O')
    SELECT query_id, item, round(score, 6) AS score, 'first' AS channel FROM f UNION ALL SELECT query_id, item, round(score * 0.85, 6), 'second' FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.query_id = s.query_id AND f.item = s.item)""")
def two_channels(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("score"), "o_orderpriority", "o_orderstatus")
    return fusion.second_channel(o.filter(F.col("o_orderpriority").startswith("1")), o.filter("o_orderstatus = 'O'"))


@query("""WITH r AS (SELECT user_id AS query_id, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    b AS (SELECT *, lag(score) OVER (PARTITION BY query_id ORDER BY i) AS p FROM r),
    k AS (SELECT query_id, least(any_value(n), coalesce(min(i) FILTER (p > 1e-8 AND (p - score) / p > 0.5 AND i >= 5 AND i < least(n, 20)), greatest(5, least(any_value(n), 20)))) AS k FROM b GROUP BY query_id)
    SELECT query_id, i, score FROM r JOIN k USING (query_id) WHERE i < k""")
def adaptive_cut(spark, d):
    line = Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")
    ranked = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("value").alias("score"), (F.row_number().over(line) - 1).alias("i"))
    return fusion.adaptive_cut(ranked).select("query_id", F.col("i").cast("long").alias("i"), "score")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(len(string_split(text, ' '))) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) WHERE s <= 200")
def token_budget(spark, d):
    c = table(spark, d, "conversations").withColumn("tokens", F.size(F.split("text", " ")))
    return fusion.token_budget(c, 200, key="conv_id", order="turn").select("conv_id", "turn")


@query("""SELECT c_custkey AS id, CASE WHEN upper(c_mktsegment) LIKE '%AUTO%' THEN 1 WHEN upper(c_mktsegment) LIKE '%BUILD%' THEN 2 WHEN upper(c_mktsegment) LIKE '%FURN%' THEN 3 ELSE 4 END AS tier,
    round(0.5 * c_acctbal / 10000 + 0.5 * (c_custkey % 100) / 100 + (4 - CASE WHEN upper(c_mktsegment) LIKE '%AUTO%' THEN 1 WHEN upper(c_mktsegment) LIKE '%BUILD%' THEN 2 WHEN upper(c_mktsegment) LIKE '%FURN%' THEN 3 ELSE 4 END) * 0.1, 8) AS score FROM customer""")
def tiered_score(spark, d):
    c = table(spark, d, "customer")
    name = F.when(F.col("c_mktsegment").contains("AUTO"), "esgo 2021").when(F.col("c_mktsegment").contains("BUILD"), "FIGO").when(F.col("c_mktsegment").contains("FURN"), "NCCN v1")
    tier = fusion.guideline_tier(name)
    return c.select(F.col("c_custkey").alias("id"), tier.alias("tier"), F.round(fusion.final_score(F.col("c_acctbal") / 10000, (F.col("c_custkey") % 100) / 100, tier), 8).alias("score"))


@query("SELECT event_id, round(1 / (1 + exp(coalesce(-value / 10, -10) - coalesce(CASE WHEN event_type <> 'click' THEN -value / 20 END, -10))), 6) AS p FROM events")
def rerank_probability(spark, d):
    e = table(spark, d, "events")
    p = fusion.yes_probability(F.when(F.col("event_type") != "click", -F.col("value") / 20), -F.col("value") / 10)
    return e.select("event_id", F.round(p, 6).alias("p"))


@query("SELECT source, 1 + row_number() OVER (ORDER BY pos, source) AS number FROM (SELECT source, min(doc_id) AS pos FROM documents WHERE source <> 'src3' GROUP BY source) UNION ALL SELECT 'src3', 1")
def bibliography(spark, d):
    return fusion.bibliography(table(spark, d, "documents").select("source", F.col("doc_id").alias("pos")), "src3").withColumn("number", F.col("number").cast("long"))


@query("SELECT b.item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def containment_join(spark, d):
    """First document that contains each item."""
    found = containment.contained(table(spark, d, "benchmark").selectExpr("item_id AS needle_id", "text AS needle"), table(spark, d, "documents").selectExpr("doc_id AS text_id", "text"))
    return found.groupBy(F.col("needle_id").alias("item_id")).agg(F.min("text_id").alias("doc_id"))


@query("""WITH l AS (SELECT item_id, text FROM benchmark UNION ALL SELECT 1000000 + conv_id * 1000 + turn, text FROM conversations)
    SELECT item_id, count(*) AS n, min(doc_id) AS first FROM l JOIN documents d ON length(l.text) > 0 AND length(d.text) > 0 AND (contains(d.text, l.text) OR contains(l.text, d.text)) GROUP BY item_id""")
def containment_both_ways(spark, d):
    """Items and turns that stand in a document, or that have a whole document in them."""
    turns = table(spark, d, "conversations").select((1000000 + F.col("conv_id") * 1000 + F.col("turn")).alias("left_id"), F.col("text").alias("left"))
    left = table(spark, d, "benchmark").select(F.col("item_id").alias("left_id"), F.col("text").alias("left")).unionByName(turns)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("right_id"), F.col("text").alias("right"))
    return containment.either_way(left, docs).groupBy(F.col("left_id").alias("item_id")).agg(F.count("*").alias("n"), F.min("right_id").alias("first"))


@query("""WITH r AS (SELECT o_custkey AS text_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, o_orderpriority LIKE '1%' AS contained, round(o_totalprice / 500000, 4) AS coherence, (o_orderkey % 100) / 100 AS sim FROM orders)
    SELECT text_id, round(CASE WHEN bool_or(contained) THEN greatest(0.01, arg_min(coherence, rank) FILTER (contained)) ELSE coalesce(max(coherence * sqrt(sim)) FILTER (sim > 0.4), 0) END, 4) AS score FROM r GROUP BY text_id""")
def real_graph_score(spark, d):
    line = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("text_id"), F.row_number().over(line).alias("rank"), F.col("o_orderpriority").startswith("1").alias("contained"), F.round(F.col("o_totalprice") / 500000, 4).alias("coherence"), ((F.col("o_orderkey") % 100) / 100).alias("sim"))
    return fusion.graph_score(rows)


@query("SELECT vec_id AS item, (least(label, 2) + 1)::INT AS level FROM embeddings ORDER BY level, vec_id % 4, vec_id LIMIT 15")
def stratified_order(spark, d):
    e = B.vectors(spark, d)
    score = F.when(F.col("label") == 0, 0.05).when(F.col("label") == 1, 0.02).otherwise(0.001)
    return fusion.stratified_order(e.select(F.col("id").alias("item"), score.alias("score"), (F.col("id") % 4).alias("tier"))).select("item", "level")
