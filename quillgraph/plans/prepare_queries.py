"""Queries of record preparation, text fields, prompts and label metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.operators import prepare as P
from quillgraph.plans import bindings as B
from quillgraph.plans.registry import query
from quillgraph.session import table


def _pick(key, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


@query(f"""SELECT id, CASE stage_raw WHEN 'IA' THEN 1 WHEN 'IB' THEN 2 WHEN 'II' THEN 3 WHEN 'IIIA' THEN 4 WHEN 'IIIB' THEN 5 WHEN 'IIIC1' THEN 6 WHEN 'IIIC2' THEN 7 WHEN 'IVA' THEN 8 WHEN 'IVB' THEN 9 ELSE 0 END AS stage,
    CASE grade WHEN 'G1' THEN 1 WHEN 'G2' THEN 2 WHEN 'G3' THEN 3 ELSE 0 END AS grade, CASE id % 3 WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN 0.75::DOUBLE END AS ratio, [1, 0, 1, 0, 0, 0][(id % 6 + 1)::INT] AS lymph, [1, 0, 1, 0][(id % 4 + 1)::INT] AS depth, [1, 0, 0][(id % 3 + 1)::INT] AS lvsi FROM ({B.PATIENTS})""")
def ordinal_codes(spark, d):
    k = F.col("id")
    return B.patients(spark, d).select(
        "id",
        P.stage_code(F.col("stage_raw")).alias("stage"),
        P.grade_code(F.col("grade")).alias("grade"),
        P.ratio_code(_pick(k, "<50%", ">=50%", "unknown")).alias("ratio"),
        P.lymph_flag(_pick(k, " Positive", "negative", "2/10", "0/4", "few", None)).alias("lymph"),
        P.has_depth(_pick(k, "4 mm", "deep", "7", None)).alias("depth"),
        P.positive_flag(_pick(k, "Positive ", "none", None)).alias("lvsi"),
    )


@query("""SELECT c_custkey AS id, ['G1', 'unknown', 'G3'][(c_custkey % 3 + 1)::INT] AS grade, [63.0, NULL, 70.5][(c_custkey % 3 + 1)::INT]::DOUBLE AS age, [1, 0, 1][(c_custkey % 3 + 1)::INT] AS lvsi_substantial, ['2/9', 'unknown', 'negative'][(c_custkey % 3 + 1)::INT] AS lymph_node_pelvic,
    'unknown' AS p53, [0, 1, 0][(c_custkey % 3 + 1)::INT] AS chemotherapy, 0 AS surgery, [2, 0, 0][(c_custkey % 3 + 1)::INT] AS level FROM customer""")
def normalised_records(spark, d):
    k = F.col("c_custkey")
    fields = F.create_map(F.lit("grade"), _pick(k, "G1", "G9", " G3"), F.lit("age"), _pick(k, "63", "old", "70.5 years"), F.lit("lvsi_substantial"), _pick(k, "yes", "?", "是"), F.lit("lymph_node_pelvic"), _pick(k, "2/9", "", "Negative"), F.lit("chemotherapy"), _pick(k, "no", "1", "maybe"), F.lit("level"), _pick(k, "2", "3", "x"))
    raw = table(spark, d, "customer").select(k.alias("id"), fields.alias("fields"))
    x, y = P.normalised_features(raw), P.normalised_treatments(raw)
    level = raw.select("id", P.ordinal(F.try_element_at("fields", F.lit("level"))).alias("level"))
    return x.join(y, "id").join(level, "id").select("id", "grade", "age", "lvsi_substantial", "lymph_node_pelvic", "p53", "chemotherapy", "surgery", "level")


@query("""SELECT c_custkey AS id, 'X_grade' AS name, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'Y_chemotherapy', CASE WHEN c_custkey % 2 = 0 THEN '1.0' ELSE '0.0' END FROM customer WHERE c_custkey % 3 <> 2""")
def flattened_records(spark, d):
    k = F.col("c_custkey")
    x = F.create_map(F.lit("grade"), F.col("c_mktsegment"), F.lit("histology_detail"), F.lit("text"))
    y = F.create_map(F.lit("chemotherapy"), F.when(k % 3 == 2, "later").when(k % 2 == 0, " 1").otherwise("0"), F.lit("follow_up"), F.lit("well"))
    return P.flattened(table(spark, d, "customer").select(k.alias("id"), x.alias("X"), y.alias("Y")))


@query(f"SELECT id, major_cv_risk * 2.0::DOUBLE AS major_cv_risk, hepatic_viral * 2.0::DOUBLE AS hepatic_viral, anemia FROM ({B.PATIENTS})")
def weighted_columns(spark, d):
    return P.weighted(B.patients(spark, d).select("id", "major_cv_risk", "hepatic_viral", "anemia", F.lit(1).alias("surgery")))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 61.5::DOUBLE END AS age, CASE WHEN c_custkey % 3 = 1 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS major_cv_risk, (c_custkey % 3 = 1)::INT AS anemia, CASE WHEN c_custkey % 3 = 2 THEN 'unknown' ELSE c_mktsegment END AS grade FROM customer""")
def prepared_patients(spark, d):
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    fields = F.create_map(F.lit("age"), F.when(k % 3 == 0, " 61.5").when(k % 3 == 1, "old").otherwise(none), F.lit("major_cv_risk"), F.when(k % 3 == 1, "1").otherwise(none), F.lit("anemia"), F.when(k % 3 == 1, "1").otherwise("?"), F.lit("grade"), F.when(k % 3 == 2, none).otherwise(F.col("c_mktsegment")))
    return P.prepared(table(spark, d, "customer").select(k.alias("id"), fields.alias("fields")), ["age"], ["major_cv_risk", "anemia"], ["grade"])


@query("""WITH s AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rank, o_totalprice, o_orderpriority, o_orderstatus FROM orders),
    c AS (SELECT id, string_agg('Case ' || rank || ' (distance ' || printf('%.3f', round(o_totalprice / 10, 3)) || '): ' || o_orderpriority || '; treated with ' || CASE WHEN o_orderstatus = 'F' THEN 'no adjuvant treatment' ELSE o_orderstatus END, chr(10) ORDER BY rank) AS c FROM s WHERE rank <= 3 GROUP BY id)
    SELECT c_custkey AS id, 'Patient' || chr(10) || c_name || chr(10) || 'Predicted' || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN '- a' || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || '- b' ELSE '' END WHEN c_custkey % 3 = 0 THEN '- b' ELSE '' END || chr(10) || 'Similar cases' || chr(10) || coalesce(c, 'none') AS prompt FROM customer LEFT JOIN c ON id = c_custkey""")
def case_prompts(spark, d):
    k = F.col("c_custkey")
    patients = table(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("line"), F.array((k % 2 == 0).cast("int"), (k % 3 == 0).cast("int")).alias("prediction"))
    line = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    similar = table(spark, d, "orders").withColumn("rank", F.row_number().over(line)).filter("rank <= 3")
    similar = similar.select(F.col("o_custkey").alias("id"), "rank", (F.col("o_totalprice") / 10).cast("double").alias("distance"), F.col("o_orderpriority").alias("line"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("regimen"))
    return P.prompts(patients, similar, ["a", "b"])


@query("""WITH p AS (SELECT positive, row_number() OVER (ORDER BY md5(positive)) - 1 AS r, count(*) OVER () AS m FROM (SELECT DISTINCT c_mktsegment || ' ' || (c_custkey % 701) AS positive FROM customer)),
    a AS (SELECT c_custkey AS id, c_mktsegment || ' ' || (c_custkey % 701) AS own, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT AS h FROM customer WHERE c_custkey % 2 = 1)
    SELECT c_custkey AS id, true AS hard, 'not ' || c_name AS negative FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT a.id, false, CASE WHEN x.positive <> own THEN x.positive ELSE y.positive END FROM a JOIN p x ON x.r = h % x.m JOIN p y ON y.r = (h + 1) % y.m""")
def random_negatives(spark, d):
    k, none = F.col("c_custkey"), "无相关困难负样本"
    positive = F.concat_ws(" ", "c_mktsegment", (k % 701).cast("string"))
    rows = table(spark, d, "customer").select(k.alias("anchor_id"), positive.alias("positive"), F.array(F.when(k % 2 == 0, F.concat(F.lit("not "), "c_name")).otherwise(none)).alias("hard_negatives"))
    return P.random_negatives(rows).select(F.col("anchor_id").alias("id"), "hard", "negative")


_ROWS = "SELECT c_custkey % 5 AS fold, [(c_custkey % 2)::INT, (c_custkey % 3 = 0)::INT, 0] AS t, [(c_custkey % 4 = 1)::INT, (c_custkey % 6 < 2)::INT, 0] AS g FROM customer"
_METRICS = f"""SELECT fold, avg((t = g)::INT) AS accuracy, avg((t[1] <> g[1])::INT + (t[2] <> g[2])::INT) / 3 AS hamming,
    avg(CASE WHEN greatest(t[1], g[1]) + greatest(t[2], g[2]) = 0 THEN 0 ELSE (t[1] * g[1] + t[2] * g[2]) / (greatest(t[1], g[1]) + greatest(t[2], g[2])) END) AS jaccard,
    (coalesce(2.0 * sum(t[1] * g[1]) / nullif(sum(t[1] + g[1]), 0), 0) + coalesce(2.0 * sum(t[2] * g[2]) / nullif(sum(t[2] + g[2]), 0), 0)) / 3 AS macro_f1 FROM ({_ROWS}) GROUP BY fold"""


def _metrics(spark, d):
    k = F.col("c_custkey")
    arrays = [F.array((k % 2).cast("int"), (k % 3 == 0).cast("int"), F.lit(0)).alias("truth"), F.array((k % 4 == 1).cast("int"), (k % 6 < 2).cast("int"), F.lit(0)).alias("guess")]
    return P.label_metrics(table(spark, d, "customer").select((k % 5).alias("fold"), *arrays), 3)


@query("SELECT fold, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("accuracy", "hamming", "jaccard", "macro_f1")) + f" FROM ({_METRICS})")
def label_metrics(spark, d):
    m = _metrics(spark, d)
    return m.select("fold", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query(f"SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM (UNPIVOT ({_METRICS}) ON accuracy, hamming, jaccard, macro_f1 INTO NAME metric VALUE value) GROUP BY metric")
def fold_summary(spark, d):
    return P.over_folds(_metrics(spark, d), ["accuracy", "hamming", "jaccard", "macro_f1"]).select("metric", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query("SELECT conv_id, turn, (sum((turn % 3 > 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn) - 1) * (turn % 3 > 0)::INT AS position FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def position_ids(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn").distinct().select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), (F.col("turn") % 3 > 0).cast("int").alias("mask"))
    return P.position_ids(rows).select(F.col("seq").alias("conv_id"), F.col("pos").alias("turn"), "position")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role FROM conversations")
def packed_turns(spark, d):
    return P.turn_roles(table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"))).select("conv_id", F.col("pos").alias("turn"), "role")


@query("""SELECT c_custkey AS id, ['glycemic_status', 'major_cv_risk', 'pneumonitis_ild', 'other'][(c_custkey % 4 + 1)::INT] AS topic, CASE c_custkey % 3 WHEN 0 THEN ['hypertension', 'major_cv_risk'] WHEN 1 THEN ['hepatic_viral'] ELSE [] END AS topics FROM customer""")
def comorbidity_topics(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), P.topic_of(_pick(k, "Diabetes", " heart", "ILD", "other")).alias("topic"), P.topics_in(_pick(k, "Hypertension after STROKE", "hbv carrier", "well")).alias("topics"))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Cancer, ' || c_mktsegment || ', stage' WHEN 1 THEN c_name END AS terms FROM customer")
def english_terms(spark, d):
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("[中文检索词]: 癌\n[英文检索词]: Cancer, "), "c_mktsegment", F.lit("，stage. ,cancer,, STAGE\nend"))).when(k % 3 == 1, F.concat(F.lit("[英文检索词] "), "c_name")).otherwise("nothing [英文检索词]: , .")
    return table(spark, d, "customer").select(k.alias("id"), P.english_terms(text).alias("terms"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS anchor_cn, CASE WHEN c_custkey % 3 = 0 THEN 'en' WHEN c_custkey % 3 = 1 THEN '' END AS anchor_en, CASE WHEN c_custkey % 3 = 0 THEN true WHEN c_custkey % 3 = 1 THEN false END AS is_complex FROM customer")
def keyword_blocks(spark, d):
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("Sure.\n<keywords>\n[中文检索词]: "), "c_name", F.lit(" \n[英文检索词]: en\n[真实方案]: plan\n[是否复杂病例]: True\n</keywords>"))).when(k % 3 == 1, F.concat(F.lit("<keywords>[中文检索词]:"), "c_name", F.lit("\n[是否复杂病例]: no</keywords>"))).otherwise("<keywords> [中文检索词]: cut off")
    found = table(spark, d, "customer").select(k.alias("id"), P.keyword_block(text).alias("b"))
    return found.select("id", "b.anchor_cn", "b.anchor_en", "b.is_complex")


@query(r"SELECT doc_id, CASE WHEN length(t) >= 50 THEN t END AS text FROM (SELECT doc_id, substr(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'), 1, 4000) AS t FROM documents)")
def case_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", P.case_text(F.col("text")).alias("text"))


@query("""SELECT c_custkey AS id, md5('{"a":' || c_custkey || ',"b":"' || c_mktsegment || '"}') AS hash FROM customer""")
def argument_hashes(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), P.args_hash(F.col("c_custkey").alias("a"), F.col("c_mktsegment").alias("b")).alias("hash"))


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND length(coalesce(text, '')) > 0")
def usable_cases(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("raw_text"), F.when(F.col("doc_id") % 2 == 0, "成功").otherwise("失败").alias("status"))
    return P.usable_cases(rows).select("doc_id")


@query("SELECT event_id, event_id % 3 = 0 AS complete FROM events")
def required_fields(spark, d):
    js = F.when(F.col("event_id") % 3 == 0, '{"a": 1, "b": "x"}').when(F.col("event_id") % 3 == 1, '{"a": 1}').otherwise('{"a": 1, "b": null}')
    return table(spark, d, "events").select("event_id", P.has_fields(js, ["a", "b"]).alias("complete"))


@query("SELECT doc_id, CASE WHEN len(string_split(text, ' ')) < 500 THEN text ELSE substr(array_to_string(string_split(text, ' ')[1:600], ' '), 1, 40) END AS text FROM documents")
def summaries(spark, d):
    """A cut stands for the language model's summary."""
    from quillgraph.operators import ingest

    return table(spark, d, "documents").select("doc_id", ingest.summarised(F.col("text"), lambda c: F.left(c, F.lit(40)), most=600).alias("text"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name || '+' || length(c_name) || '+' || (length(c_name) + 1 + length(length(c_name)::VARCHAR)) ELSE c_name || '+' || length(c_name) END AS text FROM customer")
def gleaning(spark, d):
    """Lengths stand for what the language model adds, the key for whether it wants to go on."""
    from quillgraph.operators import ingest

    k = F.col("c_custkey")
    more = lambda out: F.when(k % 2 == 0, ' "YES" ').otherwise("no")
    out = ingest.gleaned(F.col("c_name"), lambda c: F.concat(F.lit("+"), F.length(c).cast("string")), more)
    return table(spark, d, "customer").select(k.alias("id"), out.alias("text"))


@query("SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey * 2 + p)) AS number, content FROM (SELECT o_custkey, o_orderkey, p, CASE p WHEN 0 THEN o_orderpriority || ',a, b' || chr(10) || 'second line,' || o_orderstatus || ',say \"x\"' ELSE 'same' END AS content FROM orders, (VALUES (0), (1)) v(p)) GROUP BY o_custkey, content")
def csv_contexts(spark, d):
    from quillgraph.operators import curation

    csv = F.concat(F.lit('id,what,more\n1,'), "o_orderpriority", F.lit(',"a, b\nsecond line",'), "o_orderstatus", F.lit(',"say ""x"""\n\n2,same\n3\n'))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("list_no"), csv.alias("csv"))
    return curation.combined_contexts(curation.contexts_of_csv(rows)).withColumn("number", F.col("number").cast("long"))


@query("SELECT event_id, round(CASE WHEN event_type = 'click' THEN 3 ELSE 1 END * greatest(0.4 - ((g * value / 100 + (1 - g) * 0.5) - (g * 0.3 + (1 - g) * value / 200)), 0) + 0.2 * g, 6) AS loss FROM (SELECT *, (event_id % 10) / 10.0 AS g FROM events)")
def gate_loss(spark, d):
    from quillgraph.operators import tabular

    v, g = F.col("value"), (F.col("event_id") % 10) / 10.0
    return table(spark, d, "events").select("event_id", F.round(tabular.gate_loss(g, (v / 100, F.lit(0.3)), (F.lit(0.5), v / 200), F.col("event_type") == "click"), 6).alias("loss"))


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1")
def ordered_dedupe(spark, d):
    from quillgraph.operators import fusion

    return fusion.first_of_each(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT c_custkey AS id, c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'exact ' || c_name WHEN 1 THEN 'near' END AS content, 'intro' || chr(10) || '...' AS summary FROM customer WHERE c_custkey % 3 < 2")
def named_sections(spark, d):
    from quillgraph.operators import reference_docs as R

    c = table(spark, d, "customer")
    text = F.concat(F.lit("intro\n## Risk factors \nnear\n## risk\nexact "), "c_name", F.lit("\n"))
    docs = c.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))
    title = F.when(F.col("c_custkey") % 3 == 0, "risk").when(F.col("c_custkey") % 3 == 1, "FACTORS").otherwise("none")
    found = R.section_of(R.sections(docs), c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("doc_id"), title.alias("title")))
    return found.join(docs.select("doc_id", R.summary(F.col("text"), 6).alias("summary")), "doc_id").select("id", "doc_id", "content", "summary")
