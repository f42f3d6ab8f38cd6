"""Hypergraph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import graph, ingest
from quillgraph.plans import bindings as B
from quillgraph.plans.registry import query
from quillgraph.session import table

_EDGES = "SELECT o_custkey AS src, 1000000 + o_orderkey AS tgt FROM orders"
_BOTH = f"SELECT src, tgt FROM ({_EDGES}) UNION ALL SELECT tgt, src FROM ({_EDGES})"
_IDF = f"SELECT entity, count(DISTINCT hyperedge) AS df, round(ln((SELECT count(DISTINCT hyperedge) FROM ({B.INCIDENCE}))::DOUBLE / (count(DISTINCT hyperedge) + 1)) + 1.0, 4) AS idf_weight FROM ({B.INCIDENCE}) GROUP BY entity"


def _edges(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1000000).alias("tgt"))


@query(_IDF)
def idf_weights(spark, d):
    return graph.idf(B.incidence(spark, d))


@query(f"SELECT src AS node, count(*) AS degree FROM ({_BOTH}) GROUP BY src")
def node_degree(spark, d):
    return graph.degrees(_edges(spark, d))


@query(f"WITH g AS (SELECT src AS node, count(*) AS n FROM ({_BOTH}) GROUP BY src) SELECT e.src, e.tgt, a.n + b.n AS edge_degree FROM ({_EDGES}) e JOIN g a ON a.node = e.src JOIN g b ON b.node = e.tgt")
def edge_degree(spark, d):
    return graph.edge_degrees(_edges(spark, d))


@query("SELECT o_custkey AS node, list_sort(list(1000000 + o_orderkey)) AS neighbours FROM orders GROUP BY 1")
def node_edges(spark, d):
    return _edges(spark, d).groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("tgt")).alias("neighbours"))


@query(f"SELECT hyperedge, role, count(*) AS n, round(sum(weight), 4) AS weight FROM ({B.INCIDENCE}) GROUP BY ALL")
def incident_hyperedges(spark, d):
    return B.incidence(spark, d).groupBy("hyperedge", "role").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


_SIM = "SELECT o_orderkey AS hyperedge, round(o_totalprice / 500000, 4) AS sim FROM orders"


@query(f"""WITH r AS (SELECT i.*, coalesce(s.sim, 0) AS sim FROM ({B.INCIDENCE}) i LEFT JOIN ({_SIM}) s USING (hyperedge)),
    k AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n, sum((role = 'RECOMMENDATION')::INT) OVER (PARTITION BY entity) AS rec, row_number() OVER (PARTITION BY entity, role = 'RECOMMENDATION' ORDER BY sim DESC, hyperedge DESC) AS rn FROM r)
    SELECT entity, hyperedge, role FROM k WHERE n <= 20 OR role = 'RECOMMENDATION' OR rn <= 20 - rec""")
def capped_neighbours(spark, d):
    inc = B.incidence(spark, d)
    sims = inc.select("entity", "hyperedge").join(B.hyperedge_scores(spark, d).withColumnRenamed("score", "sim"), "hyperedge")
    return graph.capped_neighbours(inc, sims, 20).select("entity", "hyperedge", "role")


_COVER = f"""SELECT paper, round(sum(score) FILTER (score > 0), 4) AS coverage, CASE WHEN bool_or(rec) THEN 3 WHEN bool_or(ev) THEN 2 ELSE 1 END::INT AS tier, count(*) AS n_hyperedges FROM ({B.BELONGS}) LEFT JOIN ({B.SCORED}) USING (hyperedge)
    LEFT JOIN (SELECT hyperedge, bool_or(role = 'RECOMMENDATION') AS rec, bool_or(role = 'EVIDENCE') AS ev FROM ({B.INCIDENCE}) GROUP BY hyperedge) USING (hyperedge) GROUP BY paper HAVING max(score) > 0"""


@query(_COVER)
def parent_coverage(spark, d):
    return graph.parent_coverage(B.belongs(spark, d), B.scorer_output(spark, d), B.incidence(spark, d))


@query(f"SELECT * FROM ({_COVER}) ORDER BY tier DESC, coverage DESC, n_hyperedges DESC, paper LIMIT 5")
def top_parents(spark, d):
    return graph.top_parents(graph.parent_coverage(B.belongs(spark, d), B.scorer_output(spark, d), B.incidence(spark, d)))


@query(f"SELECT paper, hyperedge, score FROM ({B.BELONGS}) JOIN ({B.SCORES}) USING (hyperedge) QUALIFY row_number() OVER (PARTITION BY paper ORDER BY score DESC, hyperedge) <= 4")
def best_of_parent(spark, d):
    return graph.best_of_parent(B.belongs(spark, d), B.hyperedge_scores(spark, d)).select("paper", "hyperedge", "score")


_DELETE = "SELECT l_orderkey AS hyperedge, l_partkey AS entity FROM lineitem GROUP BY ALL"


@query(f"""SELECT entity, CASE WHEN bool_and(gone) THEN 'orphaned' ELSE 'shared' END AS status FROM (SELECT i.entity, g.hyperedge IS NOT NULL AS gone FROM ({_DELETE}) i LEFT JOIN (SELECT o_orderkey AS hyperedge FROM orders WHERE o_custkey % 5 = 0) g USING (hyperedge)) GROUP BY entity HAVING bool_or(gone)""")
def cascade_delete(spark, d):
    inc = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hyperedge"), F.col("l_partkey").alias("entity")).distinct()
    return graph.cascade_delete(inc, B.belongs(spark, d).filter("paper % 5 = 0"))


@query(f"""WITH s AS (SELECT hyperedge, score FROM ({B.SCORES})), p AS (SELECT DISTINCT s.hyperedge, s.score, r.hyperedge AS target FROM s JOIN ({B.INCIDENCE}) l ON l.hyperedge = s.hyperedge JOIN ({B.INCIDENCE}) r ON r.entity = l.entity AND r.hyperedge <> s.hyperedge AND r.role IN ('RECOMMENDATION', 'CONTRAINDICATION'))
    SELECT hyperedge, target, round(score * 0.8, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY hyperedge ORDER BY target) <= 3""")
def second_hop(spark, d):
    return graph.second_hop(B.incidence(spark, d), B.hyperedge_scores(spark, d)).withColumn("score", F.round("score", 6))


@query(f"SELECT hyperedge, list_sort(list(entity || ':' || role || ':' || coalesce(idf_weight, 1.0)::DECIMAL(18,4))) AS members FROM ({B.INCIDENCE}) LEFT JOIN (SELECT * FROM ({_IDF}) WHERE df > 3) USING (entity) GROUP BY hyperedge")
def subgraph_features(spark, d):
    inc = B.incidence(spark, d)
    out = graph.subgraph_features(inc, graph.idf(inc).filter("df > 3"))
    return out.select("hyperedge", F.array_sort(F.transform("members", lambda m: F.concat_ws(":", m["entity"], m["role"], m["idf_weight"].cast("decimal(18,4)")))).alias("members"))


@query("SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS tgt FROM (SELECT c_nationkey AS a, c_custkey % 25 AS b FROM customer)")
def stable_edges(spark, d):
    return graph.stable_edges(table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("src"), (F.col("c_custkey") % 25).alias("tgt")))


@query()
def largest_component(spark, d):
    """Largest component of customers and their orders' parts."""
    inc = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), (-F.col("l_partkey")).alias("tgt")).distinct()
    return graph.largest_component(inc)


@query(f"""WITH m AS (SELECT o_custkey AS hyperedge, vec_id::VARCHAR AS entity, max(role) AS role, any_value(embedding) AS v FROM ({B.INCIDENCE}) JOIN orders ON o_orderkey = hyperedge JOIN embeddings ON vec_id = entity GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY hyperedge ORDER BY entity) AS r FROM m QUALIFY r <= 5)
    SELECT hyperedge, string_agg(entity || ':' || role || ':' || round(v[1], 5)::DECIMAL(9, 5) || ':' || len(v), ' ' ORDER BY r) AS members FROM r GROUP BY hyperedge""")
def padded_tensor(spark, d):
    """A customer's parts as members, the first five of them."""
    v = B.vectors(spark, d).select(F.col("id").cast("string").alias("name"), "vector")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("hyperedge"), F.col("o_custkey").alias("c"))
    inc = B.incidence(spark, d).join(orders, "hyperedge").groupBy(F.col("c").alias("hyperedge"), F.col("entity").cast("string").alias("entity")).agg(F.max("role").alias("role"))
    text = F.transform("members", lambda m: F.concat_ws(":", m["entity"], m["role"], F.round(m["vector"][0], 5).cast("decimal(9,5)"), F.size(m["vector"])))
    return graph.padded_tensor(inc, v, 5).select("hyperedge", F.array_join(text, " ").alias("members"))


@query("""SELECT a.vec_id AS src, b.vec_id AS tgt, 'CONTEXT' AS role, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS weight FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= 3""")
def soft_neighbours(spark, d):
    v = B.vectors(spark, d).select(F.col("id").alias("node"), "vector")
    return graph.soft_neighbours(v.filter("node % 20 = 0"), v, 3, 0.3).withColumn("weight", F.round("weight", 5))


@query("SELECT chunk_id, min(pos) AS pos, any_value(l) AS lang FROM (SELECT doc_id AS pos, unnest(['c' || doc_id % 40, 'c' || doc_id % 7]) AS chunk_id FROM documents) JOIN (SELECT 'c' || doc_id AS chunk_id, lang AS l FROM documents) USING (chunk_id) GROUP BY chunk_id")
def first_source(spark, d):
    docs = table(spark, d, "documents")
    rel = docs.select(F.col("doc_id").alias("pos"), F.concat(F.lit("c"), F.col("doc_id") % 40, F.lit("<SEP>c"), F.col("doc_id") % 7).alias("source_ids"))
    return graph.first_source(rel, docs.select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), "lang"))


_VEC = "SELECT vec_id AS entity, embedding::DOUBLE[] AS v FROM embeddings"


@query(f"""WITH i AS (SELECT DISTINCT l_orderkey AS h, l_partkey AS e FROM lineitem), g AS (SELECT e, count(*) AS n FROM i GROUP BY e), s AS (SELECT a.e AS a, b.e AS b, count(*) AS shared FROM i a JOIN i b ON a.h = b.h AND a.e < b.e GROUP BY ALL)
    SELECT s.a, s.b, round(list_cosine_similarity(x.v, y.v), 4) AS cosine, round(shared / (p.n + q.n - shared), 4) AS jaccard, shared FROM s JOIN g p ON p.e = s.a JOIN g q ON q.e = s.b JOIN ({_VEC}) x ON x.entity = s.a JOIN ({_VEC}) y ON y.entity = s.b
    WHERE shared / (p.n + q.n - shared) >= 0.02 AND list_cosine_similarity(x.v, y.v) >= 0.1""")
def resolution_pairs(spark, d):
    inc = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hyperedge"), F.col("l_partkey").alias("entity"))
    v = B.vectors(spark, d).select(F.col("id").alias("entity"), "vector")
    out = ingest.resolution_pairs(inc, v, 0.1, 0.02)
    return out.select("a", "b", F.round("cosine", 4).alias("cosine"), F.round("jaccard", 4).alias("jaccard"), "shared")


@query()
def resolved_entities(spark, d):
    """Parts with like vectors that are bought together, merged one after the other; no SQL has an order in which each step changes the next."""
    inc = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hyperedge"), F.col("l_partkey").cast("string").alias("entity"))
    v = B.vectors(spark, d).select(F.col("id").cast("string").alias("entity"), "vector")
    return ingest.closure(ingest.resolve(ingest.similar_pairs(inc, v, 0.3), inc, 0.01))


@query("""WITH RECURSIVE p AS (SELECT vec_id AS variant, vec_id // 3 AS canonical FROM embeddings WHERE vec_id > 0), c AS (SELECT variant, canonical AS root FROM p UNION ALL SELECT c.variant, p.canonical FROM c JOIN p ON p.variant = c.root) SELECT variant, min(root) AS root FROM c GROUP BY variant""")
def merge_closure(spark, d):
    e = table(spark, d, "embeddings").filter("vec_id > 0")
    return ingest.closure(e.select(F.col("vec_id").alias("variant"), F.floor(F.col("vec_id") / 3).alias("canonical")))


@query("""WITH m AS (SELECT a.vec_id AS a, max(greatest(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0)) AS c FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0 GROUP BY 1) SELECT round(avg(c), 5) AS overlap FROM m""")
def semantic_overlap(spark, d):
    """Mean over the smaller set of each member's best cosine to the larger one."""
    from quillgraph.operators.vector import top_k

    v = B.vectors(spark, d)
    best = top_k(v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), v.filter("id % 20 <> 0").select("id", "vector"), 1)
    return best.agg(F.round(F.avg(F.greatest("similarity", F.lit(0.0))), 5).alias("overlap"))
