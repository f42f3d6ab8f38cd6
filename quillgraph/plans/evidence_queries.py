"""Queries of evidence, sources and the composed streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.operators import evidence as E
from quillgraph.plans import bindings as B
from quillgraph.plans.registry import query
from quillgraph.session import table

_MARK = E.MARK


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 = 3")
def noise_filter(spark, d):
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, " abc  ").when(k == 1, "RELATES_TO").when(k == 2, " EVIDENCE").otherwise(F.col("c_name"))
    return E.knowledge_only(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.alias("content"))).select("id")


@query("SELECT event_id FROM events WHERE value / 100 > 0.01")
def rerank_cut(spark, d):
    return E.above(table(spark, d, "events").select("event_id", (F.col("value") / 100).alias("score"))).select("event_id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'graph' ELSE 'vector' END AS tag FROM customer")
def lexical_tags(spark, d):
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(_MARK), "c_name", F.lit("】"))).otherwise(F.concat(F.lit(" "), F.lit(_MARK)))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), E.lexical_tag(text).alias("tag"))


_PAPERS = """SELECT 'paper::' || c_custkey AS name, CASE c_custkey % 3 WHEN 0 THEN 'P-' || c_custkey WHEN 1 THEN repeat('9', 20) END AS pmid, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS title,
    CASE c_custkey % 4 WHEN 0 THEN ['ESGO', 'x'] WHEN 1 THEN ['FIGO'] WHEN 2 THEN [] END AS guidelines, c_custkey AS k FROM customer"""


def _phone():
    return F.concat(F.lit("P-"), F.col("c_custkey").cast("string"))


def _papers(spark, d):
    k, no = F.col("c_custkey"), F.lit(None).cast("array<string>")
    guide = F.when(k % 4 == 0, F.array(F.lit("ESGO"), F.lit("x"))).when(k % 4 == 1, F.array(F.lit("FIGO"))).when(k % 4 == 2, F.array().cast("array<string>")).otherwise(no)
    return table(spark, d, "customer").select(
        F.concat(F.lit("paper::"), k.cast("string")).alias("name"),
        F.when(k % 3 == 0, _phone()).when(k % 3 == 1, F.repeat(F.lit("9"), 20)).alias("pmid"),
        F.when(k % 5 == 0, "").otherwise(F.col("c_name")).alias("title"),
        guide.alias("guidelines"),
    )


def _evidence(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), _phone().alias("c_phone")), "o_custkey")
    k = F.col("o_orderkey") % 3
    named = F.concat(F.lit(_MARK), F.lit(" paper::"), F.col("o_custkey").cast("string"), F.lit("】(Tier 3)"))
    coded = F.concat(F.lit(_MARK), "c_phone", F.lit("】"))
    return o.select(F.col("o_orderkey").alias("id"), F.when(k == 0, named).when(k == 1, coded).otherwise(F.concat(F.lit("fact "), F.col("o_orderkey").cast("string"))).alias("content"))


def _sources(spark, d):
    belongs = table(spark, d, "orders").select(F.concat(F.lit("paper::"), F.col("o_custkey").cast("string")).alias("paper"), F.concat(F.lit("<hyperedge>fact "), F.col("o_orderkey").cast("string")).alias("hyperedge"))
    return E.sources(_evidence(spark, d), _papers(spark, d), belongs)


_SOURCES = f"""SELECT o.o_orderkey AS id, p.name AS source_id, CASE WHEN p.pmid IS NOT NULL AND length(p.pmid) < 20 THEN p.pmid ELSE p.k::VARCHAR END AS pmid, CASE WHEN p.title = '' THEN 'No Title' ELSE p.title END AS title,
    coalesce(array_to_string(p.guidelines, ', '), 'General Evidence') AS guidelines FROM orders o JOIN ({_PAPERS}) p ON p.k = o.o_custkey WHERE o.o_orderkey % 3 IN (0, 2)
    UNION ALL SELECT o.o_orderkey, p.name, p.pmid, CASE WHEN p.title = '' THEN 'No Title' ELSE p.title END, coalesce(array_to_string(p.guidelines, ', '), 'General Evidence')
    FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN ({_PAPERS}) p ON p.pmid = 'P-' || c.c_custkey WHERE o.o_orderkey % 3 = 1"""


@query(_SOURCES)
def evidence_sources(spark, d):
    return _sources(spark, d)


@query(f"""WITH s AS (SELECT id, min(CASE WHEN contains(guidelines, 'ESGO') THEN 1 WHEN contains(guidelines, 'FIGO') THEN 2 WHEN contains(guidelines, 'NCCN') THEN 3 ELSE 4 END) AS t FROM ({_SOURCES}) GROUP BY id)
    SELECT o_orderkey AS id, coalesce(t, 4)::INT AS tier FROM orders LEFT JOIN s ON s.id = o_orderkey""")
def best_tier(spark, d):
    return E.best_tiers(_evidence(spark, d).select("id"), _sources(spark, d))


@query("""SELECT body, arg_min(c_name, (CASE WHEN c_custkey % 9 = 4 THEN 0 ELSE 1 END, length(title), c_name)) AS name FROM (SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 9 = 4 THEN 'FIGO ' || c_name || c_custkey ELSE c_custkey::VARCHAR END AS title FROM customer),
    (VALUES ('auto'), ('MACHINE'), ('none')) b(body) WHERE contains(lower(c_mktsegment), lower(body)) GROUP BY body""")
def guideline_paper(spark, d):
    number = F.col("c_custkey").cast("string")
    title = F.when(F.col("c_custkey") % 9 == 4, F.concat(F.lit("FIGO "), "c_name", number)).otherwise(number)
    papers = table(spark, d, "customer").select(F.col("c_name").alias("name"), title.alias("title"), F.array("c_mktsegment").alias("guidelines"))
    return E.guideline_papers(papers, ["auto", "MACHINE", "none"])


@query("SELECT c_nationkey, count(*) AS total, count_if(c_custkey % 4 = 0) AS covered, count_if(c_custkey % 4 = 1) AS partial, count_if(c_custkey % 4 = 2) AS uncovered FROM customer GROUP BY 1")
def coverage_summary(spark, d):
    k = F.col("c_custkey") % 4
    return E.coverage_summary(table(spark, d, "customer").withColumn("status", F.when(k == 0, "covered").when(k == 1, "partial").when(k == 2, "uncovered").otherwise("none")), "c_nationkey")


@query("""SELECT o_custkey AS query_id, 'fact ' || o_orderkey AS item, o_totalprice AS weight, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, '<hyperedge>fact ' || o_orderkey) - 1 AS rank FROM orders WHERE o_orderstatus <> 'P'""")
def vector_stream(spark, d):
    o = table(spark, d, "orders")
    name = F.concat(F.lit("<hyperedge>fact "), F.col("o_orderkey").cast("string")).alias("hyperedge")
    return E.vector_stream(o.select(F.col("o_custkey").alias("query_id"), name), o.filter("o_orderstatus <> 'P'").select(name, F.col("o_totalprice").alias("weight")))


@query("SELECT l_orderkey AS paper, l_suppkey AS hyperedge FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) <= 50")
def paper_neighbours(spark, d):
    return E.paper_neighbours(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("hyperedge")))


_HITS = "SELECT DISTINCT o_custkey AS query_id, l_partkey AS entity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 20 = 0"


def _hits(spark, d):
    asked = table(spark, d, "orders").filter("o_custkey % 20 = 0").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("l_orderkey"))
    return asked.join(table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("entity")), "l_orderkey").select("query_id", "entity").distinct()


@query(f"""WITH h AS ({_HITS}), n AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n, sum((role = 'RECOMMENDATION')::INT) OVER (PARTITION BY entity) AS rec, row_number() OVER (PARTITION BY entity, role = 'RECOMMENDATION' ORDER BY hyperedge DESC) AS r FROM ({B.INCIDENCE})),
    i AS (SELECT * FROM n WHERE n <= 50 OR role = 'RECOMMENDATION' OR r <= 50 - rec),
    reached AS (SELECT query_id, hyperedge, list_sort(list(DISTINCT entity)) AS es, list_sort(list(DISTINCT role)) AS rs FROM h JOIN i USING (entity) GROUP BY ALL),
    every AS (SELECT * FROM reached LEFT JOIN ({B.SCORED}) USING (hyperedge) JOIN ({B.BELONGS}) USING (hyperedge)), rows AS (SELECT * FROM every WHERE score > 0),
    c AS (SELECT query_id, paper, CASE WHEN max(list_contains(rs, 'RECOMMENDATION')::INT) = 1 THEN 3 WHEN max(list_contains(rs, 'EVIDENCE')::INT) = 1 THEN 2 ELSE 1 END AS tier, round(sum(score) FILTER (score > 0), 4) AS coverage, count(*) AS n_hyperedges FROM every GROUP BY ALL HAVING max(score) > 0),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier DESC, coverage DESC, n_hyperedges DESC, paper) AS rank FROM c QUALIFY rank <= 5),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper ORDER BY score DESC, hyperedge) AS r FROM rows QUALIFY r <= 4),
    t AS (SELECT query_id, paper, string_agg('  > 候选路径 ' || r || ' [' || array_to_string(rs, '/') || '] (神经推演推荐度: ' || printf('%.2f', score * 100) || '%)' || chr(10) || '    ├─ 方案内容: ' || hyperedge || chr(10) || '    └─ 触发该方案的局部特征: 【' || array_to_string(es, ', ') || '】' || chr(10), '' ORDER BY r) AS t FROM best GROUP BY ALL)
    SELECT query_id, paper, tier, coverage, n_hyperedges, rank, '【权威循证溯源：' || paper || '】(逻辑层级: Tier ' || tier || ', 推荐度: ' || printf('%.4f', coverage) || ')' || chr(10) || t AS text FROM top JOIN t USING (query_id, paper)""")
def graph_context(spark, d):
    return E.graph_stream(_hits(spark, d), B.incidence(spark, d), B.belongs(spark, d), B.scorer_output(spark, d))


_FOUND = "SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, o_orderkey AS hyperedge FROM orders WHERE o_custkey % 20 = 0"


def _found(spark, d):
    line = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").filter("o_custkey % 20 = 0").select(F.col("o_custkey").alias("query_id"), F.row_number().over(line).alias("pos"), F.col("o_orderkey").alias("hyperedge"))


@query(f"""WITH r AS (SELECT query_id, entity, min(pos) AS p FROM ({_FOUND}) JOIN ({B.INCIDENCE}) USING (hyperedge) GROUP BY ALL), o AS (SELECT query_id, entity, row_number() OVER (PARTITION BY query_id ORDER BY p, entity) AS pos FROM r),
    g AS (SELECT entity, count(*) AS degree FROM ({B.INCIDENCE}) GROUP BY 1), f AS (SELECT query_id, pos, entity, degree, len(string_split(p_name, ' ')) AS tokens FROM o JOIN part ON p_partkey = entity JOIN g USING (entity))
    SELECT * FROM f QUALIFY sum(tokens) OVER (PARTITION BY query_id ORDER BY pos) <= 60""")
def related_entities(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("description"))
    return E.related_entities(_found(spark, d), B.incidence(spark, d), nodes, 60)


@query(f"""WITH r AS (SELECT query_id, pos, unnest(['c' || hyperedge % 50, 'c' || hyperedge % 7]) AS chunk_id FROM ({_FOUND})), o AS (SELECT query_id, chunk_id, min(pos) AS p FROM r GROUP BY ALL),
    f AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY p, chunk_id) AS pos, chunk_id, substr(chunk_id, 2)::INT + 5 AS tokens FROM o) SELECT * FROM f QUALIFY sum(tokens) OVER (PARTITION BY query_id ORDER BY pos) <= 100""")
def related_chunks(spark, d):
    ids = F.concat(F.lit("c"), (F.col("hyperedge") % 50).cast("string"), F.lit("<SEP>c"), (F.col("hyperedge") % 7).cast("string"))
    chunks = spark.range(50).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), (F.col("id") + 5).cast("int").alias("tokens"))
    return E.related_chunks(_found(spark, d).select("query_id", "pos", ids.alias("source_ids")), chunks, 100)


@query("SELECT o_orderkey, o_custkey AS name, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 3 <> 0")
def stored_nodes(spark, d):
    nodes = table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("name"), "c_nationkey")
    return E.stored_nodes(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("name")), nodes)


@query("SELECT c_custkey AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS c_nationkey, c_custkey % 3 <> 0 AS present, coalesce(n, 0) AS degree FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def node_or_absent(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("name"), "c_nationkey")
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1000000000).alias("tgt"))
    return E.node_or_absent(c.select("name"), c.filter("name % 3 <> 0"), edges)


_WEIGHED = "SELECT o_custkey AS src, 1000000000 + o_orderkey AS tgt, o_totalprice AS weight FROM orders"


def _weighed(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1000000000).alias("tgt"), F.col("o_totalprice").alias("weight"))


@query(f"SELECT CASE WHEN tgt % 2 = 0 THEN tgt ELSE src END AS src, CASE WHEN tgt % 2 = 0 THEN src + tgt % 3 ELSE tgt END AS tgt, CASE WHEN tgt % 2 = 0 AND tgt % 3 > 0 THEN NULL ELSE weight END AS weight FROM ({_WEIGHED})")
def edge_or_absent(spark, d):
    e, turned = _weighed(spark, d), F.col("tgt") % 2 == 0
    pairs = e.select(F.when(turned, F.col("tgt")).otherwise(F.col("src")).alias("src"), F.when(turned, F.col("src") + F.col("tgt") % 3).otherwise(F.col("tgt")).alias("tgt"))
    return E.edge_or_absent(pairs, e)


@query(f"SELECT src, tgt, weight FROM ({_WEIGHED}) WHERE tgt % 5 <> 0")
def delete_edges(spark, d):
    e = _weighed(spark, d)
    return E.delete_edges(e, e.filter("tgt % 5 = 0").select(F.col("tgt").alias("src"), F.col("src").alias("tgt")), directed=False)


@query(f"SELECT src, tgt, weight FROM ({_WEIGHED}) WHERE tgt % 5 <> 0 OR tgt % 2 = 0")
def delete_directed_edges(spark, d):
    e, turned = _weighed(spark, d), F.col("tgt") % 2 == 0
    gone = e.filter("tgt % 5 = 0").select(F.when(turned, F.col("tgt")).otherwise(F.col("src")).alias("a"), F.when(turned, F.col("src")).otherwise(F.col("tgt")).alias("b"))
    return E.delete_edges(e, gone.select(F.col("a").alias("src"), F.col("b").alias("tgt")))


@query("SELECT 'node' AS kind, c_custkey AS key, c_name AS text FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'edge', o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0")
def property_match(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    matches = c.filter("c_custkey % 2 = 0").select(F.lit("node").alias("kind"), F.col("c_custkey").alias("key")).unionByName(o.filter("o_orderkey % 3 = 0").select(F.lit("edge").alias("kind"), F.col("o_orderkey").alias("key")))
    nodes, edges = E.property_match(matches, c.select(F.col("c_custkey").alias("name"), F.col("c_name").alias("text")), o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text")))
    return nodes.select(F.lit("node").alias("kind"), F.col("name").alias("key"), "text").unionByName(edges.select(F.lit("edge").alias("kind"), F.col("id").alias("key"), "text"))


@query("SELECT id, created, c_name AS content FROM (SELECT o_orderkey AS id, o_orderdate AS created, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50) LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = o_custkey")
def newest_edges(spark, d):
    edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"), F.col("o_custkey").alias("chunk_id"))
    chunks = table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("chunk_id"), F.col("c_name").alias("content"))
    return E.newest_edges(edges, chunks, 50).select("id", "created", "content")


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY'")
def workspace_rows(spark, d):
    return E.in_workspace(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("workspace")), "MACHINERY").select("id")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value / 100 END, CASE WHEN event_type = 'click' THEN 0.05 ELSE 0.1 END) AS score, round(1 / (1 + exp(-(value - 50) / 10)), 4) AS p FROM events")
def missed_scores(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", E.graph_or_default(F.when(F.col("event_id") % 3 == 0, F.col("value") / 100), F.col("event_type") == "click").alias("score"), E.probability((F.col("value") - 50) / 10).alias("p"))


@query(f"""WITH a AS (SELECT o_custkey AS anchor_id, unnest((list(DISTINCT l_partkey ORDER BY l_partkey))[-2:]) AS entity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 2 = 0 GROUP BY 1),
    f AS (SELECT entity, hyperedge FROM ({B.INCIDENCE}) WHERE role = 'EVIDENCE' QUALIFY row_number() OVER (PARTITION BY entity ORDER BY hyperedge) <= 2) SELECT DISTINCT anchor_id, hyperedge FROM a JOIN f USING (entity)""")
def contraindications(spark, d):
    bought = table(spark, d, "orders").select(F.col("o_custkey").alias("anchor_id"), F.col("o_orderkey").alias("l_orderkey")).join(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey")
    terms = F.transform(F.array_sort(F.collect_set("l_partkey")), lambda x: F.concat(F.lit(" "), x.cast("string")))
    anchors = bought.groupBy("anchor_id").agg(terms.alias("terms")).withColumn("is_complex", F.col("anchor_id") % 2 == 0)
    inc = B.incidence(spark, d).select(F.col("entity").cast("string").alias("entity"), "hyperedge", F.when(F.col("role") == "EVIDENCE", "CONTRAINDICATION").otherwise(F.col("role")).alias("role"))
    return E.contraindicated(anchors, inc)


@query("SELECT 'P-' || c_custkey AS pmid, c_name AS name FROM customer WHERE c_custkey % 20 = 0")
def paper_by_pmid(spark, d):
    c = table(spark, d, "customer").select(_phone().alias("pmid"), F.col("c_name").alias("name"), "c_custkey")
    return E.by_pmid(c, c.filter("c_custkey % 20 = 0")).select("pmid", "name")
