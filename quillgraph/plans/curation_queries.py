"""Curation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.operators import clinical, curation
from quillgraph.plans import bindings as B
from quillgraph.plans.clinical_queries import _STAGED
from quillgraph.plans.registry import query
from quillgraph.session import table


@query("""WITH r AS (SELECT p_size AS query_id, lower(p_name) AS name, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS rank FROM part)
    SELECT query_id, name FROM r WHERE rank < 5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY (NOT (contains(name, '7') OR contains(name, '3')))::INT, rank) = 1""")
def first_match(spark, d):
    line = Window.partitionBy("p_size").orderBy("p_partkey")
    ranked = table(spark, d, "part").select(F.col("p_size").alias("query_id"), F.lower("p_name").alias("name"), (F.row_number().over(line) - 1).alias("rank"))
    return curation.first_match(ranked, ["7", "3"])


@query(f"""WITH f AS (SELECT DISTINCT hyperedge, hyperedge % 5 AS topic FROM ({B.INCIDENCE}) WHERE role = 'RECOMMENDATION')
    SELECT a.c_custkey AS anchor_id, f.hyperedge FROM customer a JOIN f ON a.c_custkey % 5 <> f.topic QUALIFY row_number() OVER (PARTITION BY a.c_custkey ORDER BY md5(a.c_custkey || ':' || f.hyperedge), f.hyperedge) <= 3""")
def hard_negatives(spark, d):
    facts = B.incidence(spark, d).select("hyperedge", (F.col("hyperedge") % 5).alias("topic"), "role")
    return curation.hard_negatives_of_all(table(spark, d, "customer").select(F.col("c_custkey").alias("anchor_id"), (F.col("c_custkey") % 5).alias("topic")), facts)


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'AIR guide' WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN 'AIR 1' ELSE source END AS final_source FROM documents""")
def provenance(spark, d):
    docs = table(spark, d, "documents")
    own = F.when(F.col("doc_id") % 3 == 0, "AIR guide").otherwise(F.col("source"))
    body = F.when(F.col("doc_id") % 2 == 0, "AIR").otherwise("SEA")
    evidence = docs.select(F.col("doc_id").alias("id"), own.alias("source"), F.when(F.col("doc_id") % 3 == 1, body).otherwise("none").alias("body"))
    titles = spark.createDataFrame([("air 1 longer title",), ("AIR 1",), ("rail",)], "title string")
    return curation.redirected(evidence, titles, ["AIR", "RAIL"]).select("id", "final_source")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN ['risk'] ELSE ['IA', 'G2', c_mktsegment, 'dMMR', 'risk'] END AS words FROM customer")
def keyword_normalise(spark, d):
    c = table(spark, d, "customer")
    raw = F.when(F.col("c_custkey") % 3 == 2, " , ").otherwise(F.concat(F.lit("[a]: stage IA, II级，"), "c_mktsegment", F.lit("期\n\n MMR缺失, IA期 ")))
    return c.select(F.col("c_custkey").alias("id"), curation.keywords(raw, F.col("c_name"), F.lit("risk")).alias("words"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN [] ELSE ['h'] END AS high, CASE WHEN c_custkey % 3 = 2 THEN [] ELSE [c_name] END AS low FROM customer")
def keyword_reply(spark, d):
    js = F.concat(F.lit('{"high_level_keywords": ["h"], "low_level_keywords": ["'), "c_name", F.lit('"]}'))
    text = F.when(F.col("c_custkey") % 3 == 0, js).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Sure:\n"), js, F.lit("\nbye"))).otherwise("nothing")
    both = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), curation.keyword_json(text).alias("k"))
    return both.select("id", F.col("k.high").alias("high"), F.col("k.low").alias("low"))


@query("SELECT id, list(x ORDER BY i) AS vector FROM (SELECT label::BIGINT AS id, i, round(avg(embedding[i + 1]::DOUBLE), 5) AS x FROM embeddings, range(0, 64) r(i) GROUP BY ALL) GROUP BY id")
def mean_pooling(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    # a small negative mean rounds to minus zero, as in the SQL
    return curation.mean_pooled(e).withColumn("vector", F.transform("vector", lambda x: F.when(x < 0, -F.round(-x, 5)).otherwise(F.round(x, 5))))


@query("SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY min(CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END * 100000000 + o_orderkey)) AS number, o_orderpriority AS content FROM orders GROUP BY o_custkey, o_orderpriority")
def combined_contexts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("list_no"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("content"))
    return curation.combined_contexts(o).withColumn("number", F.col("number").cast("long"))


@query(f"SELECT id, concat_ws('; ', 'age ' || age, 'histology ' || histology_type, 'grade ' || grade, 'stage ' || CASE WHEN stage_2023 <> 'unknown' THEN stage_2023 ELSE stage_raw END, CASE WHEN molecular_subtype <> 'unknown' THEN 'class ' || molecular_subtype END) AS line FROM ({_STAGED})")
def patient_lines(spark, d):
    return clinical.staged(B.patients(spark, d)).select("id", curation.patient_text().alias("line"))


@query("SELECT event_id, round(CASE WHEN event_type = 'click' THEN 1000 ELSE 0 END + CASE WHEN event_id % 3 > 0 THEN 0.7 * (event_id % 3) / 3.0 + 0.3 * value / 100 ELSE value / 100 END + (4 - (event_id % 4 + 1)) * 0.1, 5) AS score FROM events")
def alarm_fusion(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.round(curation.alarm_fusion((F.col("event_id") % 3) / 3.0, F.col("value") / 100, F.col("event_id") % 4 + 1, F.col("event_type") == "click"), 5).alias("score"))


@query()
def node2vec(spark, d):
    n = table(spark, d, "nation")
    return curation.node2vec(n.select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 100).cast("long").alias("tgt")))
