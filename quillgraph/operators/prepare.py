"""Patient records and prompts: normalisers, ordinal codes, text fields, weights and label metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators.clinical import ALLOWED

# Ordinal codes of stages and grades, and shares of the ratio.
STAGE_CODES = {"IA": 1, "IB": 2, "II": 3, "IIIA": 4, "IIIB": 5, "IIIC1": 6, "IIIC2": 7, "IVA": 8, "IVB": 9}
GRADE_CODES = {"G1": 1, "G2": 2, "G3": 3}
RATIO_CODES = {"<50%": 0.25, ">=50%": 0.75}
#: Allowed values of the stains.
STAINS = {"p53": ["wild", "mutant", "unknown"], "mmr": ["proficient", "deficient", "unknown"], "peritoneal_cytology": ["negative", "positive", "unknown"]}
#: Text fields that are no features, columns that count double, labels that are not learnt.
TEXT_FIELDS = ["histology_detail", "stage_2023_full", "esgo_recommendation"]
WEIGHTS = {"major_cv_risk": 2.0, "hepatic_viral": 2.0}
DROPPED_LABELS = ["surgery"]
TREATMENTS = ["radiotherapy", "chemotherapy", "targeted_therapy", "immunotherapy", "hormone_therapy", "surgery"]


def _code(c: Column, codes: dict, other) -> Column:
    out = F.lit(other)
    for name, value in codes.items():
        out = F.when(c == name, value).otherwise(out)
    return out


def stage_code(c: Column) -> Column:
    return _code(c, STAGE_CODES, 0)


def grade_code(c: Column) -> Column:
    return _code(c, GRADE_CODES, 0)


def ratio_code(c: Column) -> Column:
    """Middle of the ratio's range, null where it is unknown."""
    return _code(c, RATIO_CODES, None)


def lymph_flag(c: Column) -> Column:
    """1 for positive or ``n/total`` with n over 0."""
    t = F.lower(X.strip(c))
    return F.when((t == "positive") | (F.regexp_extract(t, r"^(\d+)/", 1).try_cast("int") > 0), 1).otherwise(0)


def has_depth(c: Column) -> Column:
    return F.coalesce(c.cast("string").rlike(r"\d").cast("int"), F.lit(0))


def positive_flag(c: Column) -> Column:
    return F.coalesce((F.lower(X.strip(c.cast("string"))) == "positive").cast("int"), F.lit(0))


def normalised_features(raw: DataFrame) -> DataFrame:
    """raw(id, fields: map) as typed columns: allowed values or unknown, numbers, flags and node states."""
    get = lambda k: F.try_element_at("fields", F.lit(k))
    kept = [X.keep_allowed(get(f), values, "unknown").alias(f) for f, values in (ALLOWED | STAINS).items()]
    numbers = [X.first_number(get(f)).alias(f) for f in ("age", "myometrial_invasion_depth")]
    flags = [X.to_binary(get(f)).alias(f) for f in ("lvsi_substantial", "adnexal_involvement")]
    nodes = [X.lymph_status(get(f)).alias(f) for f in ("lymph_node_pelvic", "lymph_node_paraaortic")]
    have = set(ALLOWED)
    extra = [c for c, f in zip([*numbers, *flags, *nodes], ["age", "myometrial_invasion_depth", "lvsi_substantial", "adnexal_involvement", "lymph_node_pelvic", "lymph_node_paraaortic"], strict=True) if f not in have]
    return raw.select("id", *kept, *extra)


def normalised_treatments(raw: DataFrame) -> DataFrame:
    """raw(id, fields: map) as 0/1 treatments."""
    return raw.select("id", *[X.to_binary(F.try_element_at("fields", F.lit(t))).alias(t) for t in TREATMENTS])


def ordinal(c: Column, default: int = 0) -> Column:
    """0, 1 or 2, else the default."""
    n = X.strip(c.cast("string")).try_cast("int")
    return F.coalesce(F.when(n.isin(0, 1, 2), n), F.lit(default))


def flattened(records: DataFrame) -> DataFrame:
    """(id, name, value) of records(id, X: map, Y: map): features but text fields as X_*, labels that are numbers as Y_*."""
    rows = records.filter("id IS NOT NULL")
    features = rows.select("id", F.explode("X").alias("name", "value")).filter(~F.col("name").isin(TEXT_FIELDS)).select("id", F.concat(F.lit("X_"), "name").alias("name"), "value")
    labels = rows.select("id", F.explode("Y").alias("name", "value")).withColumn("value", X.strip(F.col("value")).try_cast("double").cast("string")).filter("value IS NOT NULL")
    return features.unionByName(labels.select("id", F.concat(F.lit("Y_"), "name").alias("name"), "value"))


def weighted(df: DataFrame, weights: dict[str, float] | None = None, drop: list[str] = DROPPED_LABELS) -> DataFrame:
    """Columns that count more, multiplied; labels that are not learnt, dropped."""
    return df.withColumns({c: F.col(c) * w for c, w in (weights or WEIGHTS).items() if c in df.columns}).drop(*drop)


def prepared(new: DataFrame, numeric: list[str], flags: list[str], categories: list[str]) -> DataFrame:
    """A new patient(id, fields: map) by classes of columns: numbers or null, flags or 0, categories or unknown; weights applied."""
    get = lambda k: F.try_element_at("fields", F.lit(k))
    number = lambda k: X.strip(get(k)).try_cast("double")
    columns = [number(c).alias(c) for c in numeric] + [F.coalesce(number(c), F.lit(0.0)).alias(c) for c in flags] + [F.coalesce(get(c), F.lit("unknown")).alias(c) for c in categories]
    out = weighted(new.select("id", *columns), drop=[])
    return out.withColumns({c: F.col(c).cast("int") for c in flags if c not in WEIGHTS})


def prompts(patients: DataFrame, similar: DataFrame, labels: list[str]) -> DataFrame:
    """(id, prompt) of patients(id, line, prediction: array of 0/1) and similar(id, rank, distance, line, regimen): the patient, what is predicted, the cases by rank."""
    predicted = F.array_join(F.filter(F.zip_with(F.array(*map(F.lit, labels)), "prediction", lambda n, y: F.when(y == 1, F.concat(F.lit("- "), n))), lambda x: x.isNotNull()), "\n")
    case = F.format_string("Case %d (distance %.3f): %s; treated with %s", "rank", F.round("distance", 3), "line", F.coalesce("regimen", F.lit("no adjuvant treatment")))
    cases = similar.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", case.alias("t")))), lambda x: x["t"]), "\n").alias("_c"))
    both = patients.join(cases, "id", "left")
    return both.select("id", F.concat_ws("\n", F.lit("Patient"), "line", F.lit("Predicted"), predicted, F.lit("Similar cases"), F.coalesce("_c", F.lit("none"))).alias("prompt"))


def random_negatives(rows: DataFrame, none: str = "无相关困难负样本") -> DataFrame:
    """(anchor_id, negative, hard) of rows(anchor_id, positive, hard_negatives): the hard ones, else another row's positive.

    Distinct positives are ranked in hash order: within the 4,096 prefixes of
    the hash by a window, before them by one count a prefix. An anchor draws the
    rank that its own hash gives, or the next one where that is its own
    positive, so each draw is an equi-join and each positive can be drawn. With
    one positive only, anchors get that.
    """
    given = rows.withColumn("_h", F.filter("hard_negatives", lambda x: x != none))
    strong = given.select("anchor_id", F.explode("_h").alias("negative"), F.lit(True).alias("hard"))
    pool = rows.select("positive").filter("positive IS NOT NULL").distinct().withColumn("_o", F.md5("positive")).withColumn("_b", F.substring("_o", 1, 3))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = pool.groupBy("_b").agg(F.count("*").alias("_n")).withColumns({"_start": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_m": F.sum("_n").over(Window.partitionBy())})
    starts = F.broadcast(starts.drop("_n"))  # a row a prefix
    line = Window.partitionBy("_b").orderBy("_o", "positive")
    ranked = pool.withColumn("_r", F.row_number().over(line) - 1).join(starts, "_b").select((F.col("_r") + F.col("_start")).alias("_r"), F.col("positive").alias("_other"))
    weak = given.filter(F.coalesce(F.size("_h"), F.lit(0)) <= 0).select("anchor_id", "positive").crossJoin(F.broadcast(starts.agg(F.max("_m").alias("_m"))))
    mark = F.conv(F.substring(F.md5(F.col("anchor_id").cast("string")), 1, 8), 16, 10).cast("long")
    drawn = weak.withColumn("_i", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_r", (mark + F.col("_i")) % F.col("_m"))
    found = drawn.join(ranked, "_r").groupBy("anchor_id", "positive").agg(F.min_by("_other", F.struct(F.col("_other").eqNullSafe(F.col("positive")), "_i")).alias("negative"))
    return strong.unionByName(found.select("anchor_id", "negative", F.lit(False).alias("hard")))


def label_metrics(rows: DataFrame, n_labels: int) -> DataFrame:
    """By fold of rows(fold, truth, guess: arrays of 0/1): subset accuracy, Hamming loss, Jaccard by row and macro F1 (0 where undefined)."""
    both = rows.withColumns({"_and": F.zip_with("truth", "guess", lambda a, b: a * b), "_or": F.zip_with("truth", "guess", lambda a, b: F.greatest(a, b)), "_diff": F.zip_with("truth", "guess", lambda a, b: F.abs(a - b))})
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x.cast("int"))
    f1 = []
    for i in range(n_labels):
        hit, all_ = F.sum(F.get("_and", F.lit(i))), F.sum(F.get("truth", F.lit(i)) + F.get("guess", F.lit(i)))
        f1.append(F.when(all_ > 0, 2.0 * hit / all_).otherwise(0.0))
    jaccard = F.when(total("_or") > 0, total("_and") / total("_or")).otherwise(0.0)
    return both.groupBy("fold").agg(
        F.avg((total("_diff") == 0).cast("double")).alias("accuracy"),
        (F.avg(total("_diff")) / n_labels).alias("hamming"),
        F.avg(jaccard).alias("jaccard"),
        (sum(f1[1:], f1[0]) / n_labels).alias("macro_f1"),
    )


def over_folds(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, mean, deviation) over the folds, population deviation."""
    return metrics.unpivot("fold", columns, "metric", "value").groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))


def position_ids(tokens: DataFrame) -> DataFrame:
    """tokens(seq, pos, mask) with ``position``: the running count of the mask less one, 0 where it is masked."""
    line = Window.partitionBy("seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("position", (F.sum("mask").over(line) - 1) * F.col("mask"))


def turn_roles(turns: DataFrame) -> DataFrame:
    """turns(id, pos from 0, content) as messages: user and assistant in turn."""
    return turns.withColumn("role", F.when(F.col("pos") % 2 == 0, "user").otherwise("assistant"))


# Topics of reference texts by other names, and words that tell a comorbidity's passages.
TOPICS = {
    "diabetes": "glycemic_status", "cv_risk": "major_cv_risk", "cardiac": "major_cv_risk", "heart": "major_cv_risk", "stroke": "major_cv_risk",
    "liver": "hepatic_dysfunction", "hbv": "hepatic_viral", "hcv": "hepatic_viral", "hepatitis": "hepatic_viral", "kidney": "renal_dysfunction",
    "renal": "renal_dysfunction", "drug_allergy": "hypersensitivity_history", "ild": "pneumonitis_ild",
}
TOPIC_WORDS = {
    "glycemic_status": ["血糖", "糖尿病", "糖代谢", "glycemic", "胰岛素", "地塞米松"],
    "hypertension": ["高血压", "血压", "hypertension", "贝伐珠", "仑伐替尼"],
    "major_cv_risk": ["心脏", "cardiac", "卒中", "stroke", "心肌梗死", "心血管", "血栓", "栓塞", "cardiovascular", "他莫昔芬"],
    "hepatic_dysfunction": ["肝", "hepatic", "胆红素", "黄疸"],
    "hepatic_viral": ["肝炎", "乙肝", "HBV", "hepatitis"],
    "anemia": ["贫血", "anemia", "血液学"],
    "hyperlipidemia": ["高脂", "血脂", "lipid"],
    "thrombosis_risk": ["血栓", "栓塞", "thrombus", "他莫昔芬"],
    "bleeding_tendency": ["出血", "bleeding"],
    "hypersensitivity_history": ["过敏", "allergic", "hypersensitivity", "脱敏", "输注反应", "infusion"],
    "peripheral_neuropathy": ["神经病变", "neuropathy", "neurotoxicity", "感觉神经"],
    "pneumonitis_ild": ["间质性肺炎", "ILD", "pneumonitis"],
    "thyroid_dysfunction": ["甲状腺", "thyroid"],
    "autoimmune_disease": ["自身免疫", "autoimmune"],
    "renal_dysfunction": ["肾", "renal"],
    "wound_healing": ["伤口", "wound", "愈合", "碎瘤", "morcellation"],
    "bmi_status": ["肥胖", "BMI", "体重"],
    "hpv_status": ["HPV", "人乳头瘤", "宫颈", "免疫治疗", "hpv感染"],
}


def topic_of(c: Column) -> Column:
    """The topic that a name stands for: itself, or the one it is another name of."""
    low, out = F.lower(X.strip(c)), F.lower(X.strip(c))
    for name, topic in TOPICS.items():
        out = F.when(low == name, topic).otherwise(out)
    return out


def topics_in(c: Column) -> Column:
    """Topics whose words a text has, in any case."""
    low = F.lower(c)
    found = [F.when(F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w)), topic) for topic, words in TOPIC_WORDS.items()]
    return F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))


def english_terms(c: Column) -> Column:
    """The line of English search terms, each once whatever its case, first spelling kept; null without any."""
    line = F.regexp_extract(c, r"(?i)\[英文检索词\]\s*:?\s*(.+)", 1)
    terms = F.filter(F.transform(F.split(X.strip(line), "[,，]"), lambda x: F.regexp_replace(X.strip(x), r"\.+$", "")), lambda x: x != "")
    low = F.transform(terms, F.lower)
    first = F.filter(terms, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return F.when(F.size(first) > 0, F.array_join(first, ", "))


def keyword_block(c: Column) -> Column:
    """struct(anchor_cn, anchor_en, raw_positive, is_complex) of a reply's keywords block, null without one."""
    block = F.regexp_extract(c, r"(?s)<keywords>(.*?)</keywords>", 1)
    field = lambda name: X.strip(F.regexp_extract(block, rf"\[{name}\]:\s*(.*)", 1))
    flag = F.lower(F.regexp_extract(block, r"\[是否复杂病例\]:\s*(True|False|true|false)", 1)) == "true"
    found = F.struct(field("中文检索词").alias("anchor_cn"), field("英文检索词").alias("anchor_en"), field("真实方案").alias("raw_positive"), flag.alias("is_complex"))
    return F.when(c.rlike(r"(?s)<keywords>.*?</keywords>"), found)


def case_text(c: Column, least: int = 50, most: int = 4000) -> Column:
    """White space folded, cut to ``most`` characters; null if shorter than ``least``."""
    t = F.left(X.strip(F.regexp_replace(c, r"\s+", " ")), F.lit(most))
    return F.when(F.length(t) >= least, t)


def args_hash(*columns: Column) -> Column:
    """md5 of the arguments as JSON."""
    return F.md5(F.to_json(F.struct(*columns)))


def usable_cases(rows: DataFrame) -> DataFrame:
    """Cases that were read with success and have a text."""
    return rows.filter((F.col("status") == "成功") & (F.length(F.coalesce("raw_text", F.lit(""))) > 0))


def has_fields(c: Column, fields: list[str]) -> Column:
    """Whether a JSON object has all the fields, none of them null."""
    return F.forall(F.array(*[F.get_json_object(c, f"$.{f}").isNotNull() for f in fields]), lambda x: x)
