"""Features, search, folds and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import tabular as M
from quillgraph.plans import bindings as B
from quillgraph.plans.registry import query
from quillgraph.session import table

_P = B.PATIENTS


@query(f"SELECT id, coalesce(myometrial_invasion_depth, (SELECT quantile_cont(myometrial_invasion_depth, 0.5) FROM ({_P}))) AS depth FROM ({_P})")
def imputed(spark, d):
    return M.median_imputed(B.patients(spark, d), ["myometrial_invasion_depth"], ["grade"], ["lvsi_substantial"]).select("id", F.col("myometrial_invasion_depth").alias("depth"))


@query(f"SELECT id, round((age - avg(age) OVER ()) / stddev_pop(age) OVER (), 4) AS z FROM ({_P})")
def z_scores(spark, d):
    return M.standardised(B.patients(spark, d).withColumn("z", F.col("age").cast("double")), ["z"]).select("id", F.round("z", 4).alias("z"))


@query(f"SELECT id, (grade = 'G1')::INT AS grade_G1, (grade = 'G2')::INT AS grade_G2, (grade = 'G3')::INT AS grade_G3, (grade = 'unknown')::INT AS grade_unknown FROM ({_P})")
def one_hot(spark, d):
    return B.patients(spark, d).select("id", *M.one_hot("grade", ["G3", "G1", "unknown", "G2"]))


@query(f"SELECT id, round(exp(m - a) / (exp(m - a) + exp(m - b)), 5) AS p0, round(exp(m - b) / (exp(m - a) + exp(m - b)), 5) AS p1 FROM (SELECT *, least(a, b) AS m FROM (SELECT id, sqrt((age / 10.0 - 4) ** 2 + (lvsi_substantial - 1.0) ** 2) AS a, sqrt((age / 10.0 - 7) ** 2 + (lvsi_substantial - 0.0) ** 2) AS b FROM ({_P})))")
def soft_clusters(spark, d):
    p = B.patients(spark, d).withColumn("f", F.array(F.col("age") / 10.0, F.col("lvsi_substantial").cast("double")))
    a, b = M.soft_assignment(F.col("f"), [[4.0, 1.0], [7.0, 0.0]])
    return p.select("id", F.round(a, 5).alias("p0"), F.round(b, 5).alias("p1"))


_F = f"SELECT id, age, lvsi_substantial AS s, balance FROM ({_P})"
_D = "abs(a.age - b.age) / 10.0 + abs(a.s - b.s) + abs(a.balance - b.balance) / 1000.0"


@query(f"WITH f AS ({_F}) SELECT a.id AS query_id, b.id, round({_D}, 5) AS distance FROM f a JOIN f b ON a.id % 20 = 0 AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) <= 3")
def similar_patients(spark, d):
    p = B.patients(spark, d).select("id", F.array(F.col("age").cast("double"), F.col("lvsi_substantial").cast("double"), F.col("balance").cast("double")).alias("features"))
    near = M.nearest(p.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), p, 3, exclude_self=True, units=(10.0, 1.0, 1000.0))
    return near.select("query_id", "id", F.round("distance", 5).alias("distance"))


@query("SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) % 5 AS fold FROM labels")
def stratified_folds(spark, d):
    return M.folds(table(spark, d, "labels"), "quality", "doc_id").select("doc_id", F.col("quality"), F.col("fold").cast("long").alias("fold"))


@query("SELECT round(avg(quality), 6) AS quality_rate, round(avg(toxic), 6) AS toxic_rate, round(sum(1 - toxic) / (sum(toxic) + 1e-5), 4) AS class_weight FROM labels")
def label_rates(spark, d):
    return table(spark, d, "labels").agg(F.round(F.avg("quality"), 6).alias("quality_rate"), F.round(F.avg("toxic"), 6).alias("toxic_rate"), F.round(F.sum(1 - F.col("toxic")) / (F.sum("toxic") + 1e-5), 4).alias("class_weight"))


@query("""WITH s AS (SELECT quality AS y, n_chars AS x FROM labels JOIN documents USING (doc_id)), g AS (SELECT x, sum(y) AS p, sum(1 - y) AS q FROM s GROUP BY x)
    SELECT round(sum(w) / ((SELECT sum(p) FROM g) * (SELECT sum(q) FROM g)), 6) AS auc FROM (SELECT p * (coalesce(sum(q) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS w FROM g)""")
def auc(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return M.auc(rows, "quality", "n_chars").select(F.round("auc", 6).alias("auc"))


@query("SELECT round(avg((p = y)::INT), 6) AS accuracy, round(2.0 * sum(p * y) / (sum(p) + sum(y)), 6) AS f1, round(avg(abs(p - y)), 6) AS hamming FROM (SELECT quality AS y, (n_chars > 400)::INT AS p FROM labels JOIN documents USING (doc_id))")
def classifier_metrics(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") > 400).cast("int").alias("p"))
    return rows.agg(F.round(F.avg((F.col("p") == F.col("y")).cast("int")), 6).alias("accuracy"), F.round(2.0 * F.sum(F.col("p") * F.col("y")) / (F.sum("p") + F.sum("y")), 6).alias("f1"), F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 6).alias("hamming"))


_MISS = "avg((coalesce(lower({0}::VARCHAR), '') IN ('', 'unknown', 'none'))::INT)"


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, round({_MISS.format(c)}, 6) AS missing_rate FROM ({_P})" for c in ("grade", "stage_raw", "myometrial_invasion_depth", "cervical_involvement")) + ")")
def missing_rates(spark, d):
    return M.missing_rates(B.patients(spark, d), ["grade", "stage_raw", "myometrial_invasion_depth", "cervical_involvement"]).withColumn("missing_rate", F.round("missing_rate", 6))


@query("SELECT field, value, n, round(n / sum(n) OVER (PARTITION BY field), 6) AS share FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS n FROM ({_P}) GROUP BY 2" for c in ("grade", "lvsi", "segment")) + ")")
def distributions(spark, d):
    return M.distribution(B.patients(spark, d), ["grade", "lvsi", "segment"])


@query("SELECT text_id, n FROM (SELECT md5(text) AS text_id, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def duplicate_ids(spark, d):
    return M.duplicates(table(spark, d, "documents").select(F.md5("text").alias("text_id")), "text_id")


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS total, count_if(n_chars < 200) AS warnings FROM documents GROUP BY source")
def extraction_summary(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), F.count_if(F.col("n_chars") < 200).alias("warnings"))


@query("SELECT event_id, round(greatest(0.4 - (value / 100 - (event_id % 10) / 10.0), 0), 6) AS loss FROM events")
def margin_loss(spark, d):
    return table(spark, d, "events").select("event_id", F.round(M.margin_loss(F.col("value") / 100, (F.col("event_id") % 10) / 10.0), 6).alias("loss"))


@query("SELECT event_id, round(-ln(exp(0.5 / 0.15) / (exp(0.5 / 0.15) + 2 * exp(((event_id % 10) / 10.0) / 0.15) + exp(0.1 / 0.15))), 5) AS loss FROM events")
def contrastive_loss(spark, d):
    negs = M.padded_negatives(F.array(F.lit(0.1), (F.col("event_id") % 10) / 10.0), 3)
    return table(spark, d, "events").select("event_id", F.round(M.contrastive_loss(F.lit(0.5), negs), 5).alias("loss"))


@query("SELECT doc_id, unnest(list_filter([CASE WHEN lang = 'fr' THEN source END, CASE WHEN doc_id % 2 = 0 THEN lang END], lambda x: x IS NOT NULL)) AS anchor FROM documents")
def bilingual_anchors(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "fr", F.col("source")).alias("anchor_cn"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("anchor_en"))
    return M.both_languages(rows)


@query("SELECT p.id, p.grade, coalesce(c.n, 0) AS n_orders, coalesce(c.total, 0.0) AS total FROM (" + _P + ") p LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) c ON c.o_custkey = p.id")
def merged_features(spark, d):
    c = table(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return B.patients(spark, d).join(c, "id", "left").select("id", "grade", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query()
def kmeans_clusters(spark, d):
    """Soft features' clusters by pyspark.ml."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    p = B.patients(spark, d).select("id", array_to_vector(F.array(F.col("age").cast("double"), F.col("lvsi_substantial").cast("double"))).alias("features"))
    return KMeans(k=3, seed=42).fit(p).transform(p).select("id", "prediction")
