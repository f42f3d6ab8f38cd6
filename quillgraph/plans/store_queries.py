"""Store semantics and scans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillgraph.operators import store
from quillgraph.plans.registry import query
from quillgraph.session import table


def _two(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"))
    new = c.filter("id % 3 = 0").select((F.col("id") + 30).alias("id"), F.lit(None).cast("string").alias("name"), (F.col("value") * 2).alias("value"))
    return c.filter("id % 2 = 0"), new


_OLD = "SELECT c_custkey AS id, c_name AS name, c_acctbal AS value FROM customer WHERE c_custkey % 2 = 0"
_NEW = "SELECT c_custkey + 30 AS id, NULL::VARCHAR AS name, c_acctbal * 2 AS value FROM customer WHERE c_custkey % 3 = 0"


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)")
def upsert_absent(spark, d):
    return store.insert_absent(*_two(spark, d), "id")


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.value, o.value) AS value FROM o FULL JOIN n ON o.id = n.id")
def upsert_fields(spark, d):
    return store.overwrite_fields(*_two(spark, d), "id")


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)")
def upsert_rows(spark, d):
    return store.overwrite_rows(*_two(spark, d), ["id"], ["value"])


@query(f"SELECT id FROM ({_NEW}) WHERE id NOT IN (SELECT id FROM ({_OLD}))")
def filter_keys(spark, d):
    old, new = _two(spark, d)
    return store.missing_keys(new.select("id"), old, "id")


@query(f"SELECT n.id, n.id * 10 AS pos, o.name FROM ({_NEW}) n LEFT JOIN ({_OLD}) o USING (id)")
def get_by_ids(spark, d):
    old, new = _two(spark, d)
    ids = new.select("id", (F.col("id") * 10).alias("pos"))
    return store.by_ids(ids, old.select("id", "name"), "id").select("id", "pos", "name")


@query("SELECT o_custkey AS src, o_orderkey AS tgt FROM orders WHERE o_custkey % 7 <> 0 AND o_orderkey % 5 <> 0")
def delete_nodes(spark, d):
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("tgt"))
    edges = edges.select((F.col("src") * 2).alias("src"), (F.col("tgt") * 2 + 1).alias("tgt"))  # names of both kinds stay apart
    nodes = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("tgt").alias("name"))).distinct()
    gone = nodes.filter("(name % 2 = 0 AND name % 7 = 0) OR (name % 2 = 1 AND (name - 1) % 5 = 0)")
    left = store.delete_nodes(nodes, edges, gone)[1]
    return left.select((F.col("src") / 2).cast("long").alias("src"), ((F.col("tgt") - 1) / 2).cast("long").alias("tgt"))


@query("SELECT p_partkey AS id FROM part WHERE NOT (p_size > 25 OR p_name LIKE '%1%')")
def delete_relation(spark, d):
    return store.delete_where(table(spark, d, "part"), (F.col("p_size") > 25) | F.col("p_name").contains("1")).select(F.col("p_partkey").alias("id"))


@query("SELECT c_custkey AS paper, list_sort(CASE WHEN c_custkey % 4 = 0 THEN ['ESGO', c_mktsegment] ELSE [c_mktsegment] END) AS guidelines FROM customer")
def paper_guidelines(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("paper"), F.array("c_mktsegment").alias("guidelines"))
    once = store.add_guideline(p, F.col("paper") % 4 == 0, "ESGO")
    return store.add_guideline(once, F.col("paper") % 4 == 0, "ESGO").withColumn("guidelines", F.array_sort("guidelines"))


@query("SELECT p_partkey AS entity, CASE WHEN p_partkey % 3 = 0 THEN p_size * 0.5 ELSE 1.0 END::DOUBLE AS idf_weight FROM part")
def idf_write_back(spark, d):
    p = table(spark, d, "part")
    base = p.select(F.col("p_partkey").alias("entity"), F.lit(1.0).alias("idf_weight"))
    new = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("entity"), (F.col("p_size") * 0.5).alias("idf_weight"))
    return store.write_back(base, new, "entity", "idf_weight")


@query("""WITH a AS (SELECT s_suppkey AS id, s_name AS name, s_acctbal AS value FROM supplier), b AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'changed ' || id ELSE name END AS name, CASE WHEN id % 3 = 0 THEN value * 2 ELSE value END AS value FROM a),
    c AS (SELECT id, name, CASE WHEN id % 5 = 0 THEN -1 ELSE value END AS value FROM b UNION ALL SELECT id + 1000000, 'new', 0 FROM a WHERE id % 4 = 0)
    SELECT 'one' AS workspace, id, name, value::DOUBLE AS value FROM c WHERE NOT (id < 1000000 AND id % 7 = 0) UNION ALL SELECT 'two', id, 'other', 5 FROM a WHERE id % 2 = 0""")
def stored_workspaces(spark, d):
    """Suppliers in a store of two workspaces: rows replaced, fields set, new ones added, some deleted and folded."""
    from quillgraph.session import shared_folder
    from quillgraph.sources.tables import DeltaStore

    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    one, two = DeltaStore(spark, root, "one"), DeltaStore(spark, root, "two")
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("value"))
    one.upsert("suppliers", a, "id")
    two.upsert("suppliers", a.filter("id % 2 = 0").withColumns({"name": F.lit("other"), "value": F.lit(5.0)}), "id")
    one.upsert("suppliers", a.filter("id % 3 = 0").withColumns({"name": F.concat(F.lit("changed "), "id"), "value": F.col("value") * 2}), "id", "rows")
    one.upsert("suppliers", a.filter("id % 5 = 0").select("id", F.lit(None).cast("string").alias("name"), F.lit(-1.0).alias("value")), "id", "fields")
    one.compact("suppliers")
    one.upsert("suppliers", a.filter("id % 4 = 0").selectExpr("id + 1000000 AS id", "'new' AS name", "0D AS value").unionByName(a.withColumn("name", F.lit("known"))), "id")
    one.delete("suppliers", a.filter("id % 7 = 0"))
    return one.read("suppliers").withColumn("workspace", F.lit("one")).unionByName(two.read("suppliers").withColumn("workspace", F.lit("two")))


@query("SELECT o_orderstatus = 'F' AS ok, count(*) AS n FROM orders GROUP BY 1")
def result_split(spark, d):
    ok, bad = store.split_results(table(spark, d, "orders"), F.col("o_orderstatus") == "F")
    return ok.agg(F.count("*").alias("n")).select(F.lit(True).alias("ok"), "n").unionByName(bad.agg(F.count("*").alias("n")).select(F.lit(False).alias("ok"), "n"))


@query("SELECT vec_id AS id, len(embedding) AS dim FROM embeddings")
def vector_scan(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").cast("long").alias("dim"))


@query("SELECT o_custkey AS paper, count(*) AS n FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) ON c_custkey = o_custkey GROUP BY 1")
def exists_check(spark, d):
    c = table(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(c, "o_custkey", "left_semi").groupBy(F.col("o_custkey").alias("paper")).agg(F.count("*").alias("n"))


@query("""SELECT c.c_custkey AS node, coalesce(array_to_string(list_sort(list(d.source) FILTER (d.source IS NOT NULL)), ','), '') AS sources, count(d.doc_id) AS n FROM (SELECT c_custkey, unnest([c_custkey, c_custkey * 3]) AS k FROM customer) c LEFT JOIN documents d ON d.doc_id = c.k GROUP BY 1""")
def nodes_with_sources(spark, d):
    """Nodes with what their listed sources say, also those without any."""
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.explode_outer(F.array(F.col("c_custkey"), F.col("c_custkey") * 3)).alias("doc_id"))
    docs = table(spark, d, "documents").select("doc_id", "source")
    by = keys.join(docs, "doc_id", "left").groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"), F.count("source").alias("n"))
    return by.select("node", "sources", "n")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def newest(spark, d):
    return table(spark, d, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(20).select("o_orderkey", "o_orderdate")


@query("SELECT count(DISTINCT n) AS nodes, sum(e)::BIGINT AS edges FROM (SELECT o_custkey AS n, 0 AS e FROM orders UNION SELECT -o_orderkey, 1 FROM orders)")
def graph_statistics(spark, d):
    o = table(spark, d, "orders")
    both = o.select(F.col("o_custkey").alias("n"), F.lit(0).alias("e")).union(o.select(-F.col("o_orderkey"), F.lit(1))).distinct()
    return both.agg(F.countDistinct("n").alias("nodes"), F.sum("e").cast("long").alias("edges"))
