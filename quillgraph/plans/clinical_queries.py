"""Rule engines over patients."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import clinical as C
from quillgraph.plans import bindings as B
from quillgraph.plans.registry import query
from quillgraph.session import table

_IN = lambda names: "(" + ", ".join(repr(n) for n in names) + ")"
_AGGR = f"(histology_type IN {_IN(C.AGGRESSIVE)} OR (histology_type = 'endometrioid' AND grade = 'G3'))"
_BASE = f"""CASE WHEN stage_raw = 'IIIA' THEN CASE WHEN adnexal_involvement = 1 THEN 'IIIA1' ELSE 'IIIA2' END WHEN stage_raw = 'IIIB' THEN 'IIIB1'
    WHEN stage_raw = 'II' THEN CASE WHEN {_AGGR} THEN 'IIC' WHEN lvsi_substantial = 1 THEN 'IIB' ELSE 'IIA' END
    WHEN stage_raw = 'IA' AND adnexal_involvement = 1 AND NOT {_AGGR} AND (coalesce(myometrial_invasion_depth = 0, false) OR myometrial_invasion_ratio = '<50%') THEN 'IA3'
    WHEN stage_raw = 'IA' AND {_AGGR} THEN 'IC' WHEN stage_raw = 'IB' AND {_AGGR} THEN CASE WHEN cervical_involvement = 'stromal' OR lvsi_substantial = 1 THEN 'IIC' ELSE 'IC' END
    WHEN stage_raw = 'IA' THEN CASE WHEN myometrial_invasion_depth = 0 THEN 'IA1' WHEN lvsi_substantial = 1 THEN 'IIB' ELSE 'IA2' END
    WHEN stage_raw = 'IB' THEN CASE WHEN myometrial_invasion_ratio = '>=50%' AND lvsi_substantial = 1 THEN 'IIB' ELSE 'IB' END ELSE stage_raw END"""
_STAGED = f"""SELECT *, CASE WHEN NOT confident THEN 'unknown' WHEN base NOT IN {_IN(C.EARLY)} THEN base WHEN molecular_subtype = 'POLEmut' THEN 'IA' WHEN molecular_subtype = 'p53abn' THEN 'IIC' ELSE base END AS stage_2023,
    CASE WHEN NOT confident THEN 'unknown' WHEN base NOT IN {_IN(C.EARLY)} THEN base WHEN molecular_subtype = 'POLEmut' THEN 'IAmPOLEmut' WHEN molecular_subtype = 'p53abn' THEN 'IICmp53abn' WHEN molecular_subtype IN ('MMRd', 'NSMP') THEN base || 'm' || molecular_subtype ELSE base END AS stage_2023_full
    FROM (SELECT *, figo_version = '2023' OR (stage_raw <> 'unknown' AND histology_type <> 'unknown' AND grade <> 'unknown' AND myometrial_invasion_ratio <> 'unknown') AS confident, CASE WHEN figo_version = '2023' THEN stage_raw ELSE {_BASE} END AS base FROM ({B.PATIENTS}))"""
_A, _BC, _TWO, _LATE, _SUB = "stage_2023 IN ('IA','IA1','IA2','IA3')", "stage_2023 IN ('IB','IC')", "stage_2023 IN ('II','IIA','IIB')", "(stage_2023 LIKE 'III%' OR stage_2023 LIKE 'IV%')", "lvsi_substantial = 1"
_LOW, _NEG = "grade IN ('G1','G2')", "lvsi = 'negative'"
_RISK = f"""CASE WHEN histology_type IN {_IN(C.AGGRESSIVE)} THEN 'High'
    WHEN molecular_subtype = 'POLEmut' AND ({_A} OR {_TWO} OR stage_2023 IN ('IB','I','IIC')) THEN 'Low' WHEN molecular_subtype = 'POLEmut' AND {_LATE} THEN 'Uncertain'
    WHEN molecular_subtype = 'p53abn' AND ({_A} OR stage_2023 IN ('IB','IIC')) THEN CASE WHEN myometrial_invasion_ratio = '>=50%' OR {_SUB} THEN 'High' ELSE 'High-Intermediate' END WHEN molecular_subtype = 'p53abn' AND {_LATE} THEN 'High'
    WHEN molecular_subtype <> 'unknown' THEN CASE WHEN {_A} THEN CASE WHEN {_LOW} AND NOT {_SUB} THEN 'Low' ELSE 'Intermediate' END WHEN {_BC} THEN CASE WHEN {_LOW} AND NOT {_SUB} THEN 'Intermediate' ELSE 'High-Intermediate' END
      WHEN {_TWO} THEN CASE WHEN {_SUB} THEN 'High-Intermediate' ELSE 'Intermediate' END WHEN stage_2023 = 'IIC' OR {_LATE} THEN 'High' ELSE 'Uncertain' END
    WHEN {_A} THEN CASE WHEN {_LOW} AND {_NEG} THEN 'Low' WHEN grade = 'G3' OR lvsi = 'positive' THEN 'Intermediate' ELSE 'Uncertain' END
    WHEN {_BC} THEN CASE WHEN {_LOW} AND {_NEG} THEN 'Intermediate' ELSE 'High-Intermediate' END WHEN {_TWO} THEN 'High-Intermediate' WHEN {_LATE} THEN 'High' ELSE 'Uncertain' END"""


@query(f"SELECT id, confident, stage_2023, stage_2023_full FROM ({_STAGED})")
def staging(spark, d):
    return C.staged(B.patients(spark, d)).select("id", "confident", "stage_2023", "stage_2023_full")


@query(f"SELECT id, {_RISK} AS risk_group FROM ({_STAGED})")
def risk_groups(spark, d):
    return C.staged(B.patients(spark, d)).select("id", C.risk_group().alias("risk_group"))


@query(f"""SELECT risk_group, label, advice, count(*) AS n FROM (SELECT risk_group, CASE risk_group WHEN 'Low' THEN 'Low Risk' WHEN 'Intermediate' THEN 'Intermediate Risk' WHEN 'High-Intermediate' THEN 'High-Intermediate Risk' WHEN 'High' THEN 'High Risk' ELSE 'Uncertain Risk' END AS label,
    CASE WHEN risk_group = 'High' AND molecular_subtype = 'MMRd' AND stage_2023 LIKE 'III%' THEN '{C.ADVICE_MMRD}' {' '.join(f"WHEN risk_group = '{k}' THEN '{v}'" for k, v in C.ADVICE.items())} ELSE '{C.ADVICE_NONE}' END AS advice FROM (SELECT *, {_RISK} AS risk_group FROM ({_STAGED}))) GROUP BY ALL""")
def adjuvant_advice(spark, d):
    df = C.staged(B.patients(spark, d)).withColumn("risk_group", C.risk_group())
    return df.select("risk_group", C.risk_label().alias("label"), C.advice().alias("advice")).groupBy("risk_group", "label", "advice").agg(F.count("*").alias("n"))


@query("SELECT * FROM (UNPIVOT (SELECT id, " + ", ".join(C.COMORBIDITIES) + f" FROM ({B.PATIENTS})) ON " + ", ".join(C.COMORBIDITIES) + " INTO NAME comorbidity VALUE value) WHERE value > 0")
def comorbidities(spark, d):
    return C.comorbidity_rows(B.patients(spark, d))


@query(f"SELECT id, list_filter([CASE WHEN major_cv_risk > 0 THEN 'major_cv_risk' END, CASE WHEN age >= 75 THEN 'age' END], lambda x: x IS NOT NULL) AS reasons FROM ({B.PATIENTS})")
def board_overrides(spark, d):
    return B.patients(spark, d).select("id", C.overrides().alias("reasons"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'G1' WHEN 1 THEN 'unknown' WHEN 2 THEN 'unknown' ELSE 'unknown' END AS grade, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 0 END::INT AS flag,
    CASE c_custkey % 4 WHEN 0 THEN 12 WHEN 1 THEN -1 WHEN 2 THEN 3 ELSE -1 END::INT AS number, CASE c_custkey % 4 WHEN 0 THEN '2/10' WHEN 1 THEN 'positive' ELSE 'unknown' END AS lymph, CASE c_custkey % 4 WHEN 0 THEN 4.5 WHEN 1 THEN 7.0 END::DOUBLE AS depth FROM customer""")
def normalised_fields(spark, d):
    k = F.col("c_custkey") % 4
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        X.keep_allowed(pick(" G1 ", "g2x", "Unknown", ""), ["G1", "G2", "G3", "unknown"], "unknown").alias("grade"),
        X.to_binary(pick("Yes", "no", "是", "maybe")).alias("flag"),
        X.to_integer(pick("12.9", "x", " 3 ", ""), -1).alias("number"),
        X.lymph_status(pick("2/10", "Positive", "few", "1 / 2")).alias("lymph"),
        X.first_number(pick("about 4.5 mm", "7", "none", "")).alias("depth"),
    )


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'IIIC1ii' WHEN 1 THEN 'IB' WHEN 3 THEN 'IAmPOLEmut' END AS stage FROM documents")
def stage_strings(spark, d):
    k = F.col("doc_id") % 4
    text = F.when(k == 0, "stage IA, later FIGO分期： IIIC1ii, not IB").when(k == 3, "so it is IB or (IAmPOLEmut).").when(k == 1, "was IA and is now IB").otherwise("no stage here")
    return table(spark, d, "documents").select("doc_id", X.stage_of(text).alias("stage"))
