"""Rule engines as pure column expressions over patient fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The enumerations of a patient record.
ALLOWED = {
    "menopause": ["yes", "no", "unknown"],
    "histology_type": ["endometrioid", "serous", "clear_cell", "carcinosarcoma", "mixed", "unknown"],
    "grade": ["G1", "G2", "G3", "unknown"],
    "stage_raw": ["IA", "IB", "II", "IIIA", "IIIB", "IIIC1", "IIIC2", "IVA", "IVB", "IA1", "IA2", "IA3", "IC", "IIA", "IIB", "IIC", "IIIA1", "IIIA2", "IIIB1", "IIIB2", "IVC", "unknown"],
    "figo_version": ["2009", "2023", "unknown"],
    "myometrial_invasion_ratio": ["<50%", ">=50%", "unknown"],
    "cervical_involvement": ["none", "glandular", "stromal", "unknown"],
    "lvsi": ["positive", "negative", "unknown"],
    "molecular_subtype": ["POLEmut", "MMRd", "NSMP", "p53abn", "unknown"],
}
AGGRESSIVE = ["serous", "clear_cell", "carcinosarcoma", "undifferentiated", "mixed"]
EARLY = ["IA", "IA1", "IA2", "IA3", "IB", "IC", "IIA", "IIB", "IIC"]

_c = F.col


def aggressive_histology() -> Column:
    """Aggressive by type, or endometrioid of grade 3."""
    return _c("histology_type").isin(AGGRESSIVE) | ((_c("histology_type") == "endometrioid") & (_c("grade") == "G3"))


def base_stage() -> Column:
    """Anatomic stage of the 2023 system from a 2009 stage: the first rule that holds decides."""
    stage, aggr, sub = _c("stage_raw"), aggressive_histology(), _c("lvsi_substantial") == 1
    depth0 = F.coalesce(_c("myometrial_invasion_depth") == 0, F.lit(False))
    ratio = _c("myometrial_invasion_ratio")
    adnexal = _c("adnexal_involvement") == 1
    rules = [
        (stage == "IIIA", F.when(adnexal, "IIIA1").otherwise("IIIA2")),
        (stage == "IIIB", F.lit("IIIB1")),
        (stage == "II", F.when(aggr, "IIC").when(sub, "IIB").otherwise("IIA")),
        ((stage == "IA") & adnexal & ~aggr & (depth0 | (ratio == "<50%")), F.lit("IA3")),
        ((stage == "IA") & aggr, F.lit("IC")),
        ((stage == "IB") & aggr, F.when((_c("cervical_involvement") == "stromal") | sub, "IIC").otherwise("IC")),
        (stage == "IA", F.when(depth0, "IA1").when(sub, "IIB").otherwise("IA2")),
        (stage == "IB", F.when((ratio == ">=50%") & sub, "IIB").otherwise("IB")),
    ]
    return _first(rules, stage)


def _first(rules: list[tuple[Column, Column]], default: Column) -> Column:
    out = default
    for holds, value in reversed(rules):
        out = F.when(holds, value).otherwise(out)
    return out


def with_molecular(stage: Column, full: bool) -> Column:
    """Stage after the molecular class; full: with its mark. Early stages only."""
    mol = _c("molecular_subtype")
    early = F.split(stage, "m")[0].isin(EARLY)
    marked = (lambda s, m: F.concat(s, F.lit(m))) if full else (lambda s, m: s)
    changed = F.when(mol == "POLEmut", marked(F.lit("IA"), "mPOLEmut")).when(mol == "p53abn", marked(F.lit("IIC"), "mp53abn"))
    changed = changed.when(mol == "MMRd", marked(stage, "mMMRd")).when(mol == "NSMP", marked(stage, "mNSMP"))
    return F.when(early, F.coalesce(changed, stage)).otherwise(stage)


def staged(patients: DataFrame) -> DataFrame:
    """patients with stage_2023, stage_2023_full and confident."""
    known = F.lit(True)
    for f in ("stage_raw", "histology_type", "grade", "myometrial_invasion_ratio"):
        known = known & (_c(f) != "unknown")
    new = _c("figo_version") == "2023"
    df = patients.withColumn("_base", F.when(new, _c("stage_raw")).otherwise(base_stage())).withColumn("confident", new | (known & (_c("_base") != "unknown")))
    value = lambda full: F.when(_c("confident"), with_molecular(_c("_base"), full)).otherwise("unknown")
    return df.withColumns({"stage_2023": value(False), "stage_2023_full": value(True)}).drop("_base")


def risk_group() -> Column:
    """Risk group from stage_2023 and the other fields, with each rule in its order."""
    stage, mol, grade = _c("stage_2023"), _c("molecular_subtype"), _c("grade")
    sub, low_grade = _c("lvsi_substantial") == 1, grade.isin("G1", "G2")
    one_a, one_bc, two = stage.isin("IA", "IA1", "IA2", "IA3"), stage.isin("IB", "IC"), stage.isin("II", "IIA", "IIB")
    late = stage.startswith("III") | stage.startswith("IV")
    known, negative = mol != "unknown", _c("lvsi") == "negative"
    pole, p53 = mol == "POLEmut", mol == "p53abn"
    rules = [
        (_c("histology_type").isin(AGGRESSIVE), F.lit("High")),
        (pole & (one_a | two | stage.isin("IB", "I", "IIC")), F.lit("Low")),
        (pole & late, F.lit("Uncertain")),
        (p53 & (one_a | stage.isin("IB", "IIC")), F.when((_c("myometrial_invasion_ratio") == ">=50%") | sub, "High").otherwise("High-Intermediate")),
        (p53 & late, F.lit("High")),
        (known & one_a, F.when(low_grade & ~sub, "Low").otherwise("Intermediate")),
        (known & one_bc, F.when(low_grade & ~sub, "Intermediate").otherwise("High-Intermediate")),
        (known & two, F.when(sub, "High-Intermediate").otherwise("Intermediate")),
        (known & ((stage == "IIC") | late), F.lit("High")),
        (~known & one_a, F.when(low_grade & negative, "Low").when((grade == "G3") | (_c("lvsi") == "positive"), "Intermediate").otherwise("Uncertain")),
        (~known & one_bc, F.when(low_grade & negative, "Intermediate").otherwise("High-Intermediate")),
        (~known & two, F.lit("High-Intermediate")),
        (~known & late, F.lit("High")),
    ]
    return _first(rules, F.lit("Uncertain"))


# Advice by risk group, and how groups are labelled.
ADVICE = {
    "Low": "No adjuvant therapy recommended.",
    "Intermediate": "Vaginal brachytherapy should be considered. No adjuvant therapy is an option for patients <60 years or low-grade tumors.",
    "High-Intermediate": "External beam radiotherapy (EBRT) is recommended for optimal pelvic control. Vaginal brachytherapy is an alternative if lymph node staging was done and pN0.",
    "High": "EBRT with concurrent and adjuvant chemotherapy, or sequential chemotherapy and radiotherapy.",
}
ADVICE_MMRD = "EBRT with concurrent/sequential chemotherapy. Consider adding immune checkpoint inhibitor for MMRd tumors."
ADVICE_NONE = "Insufficient data for firm recommendation. Multidisciplinary discussion advised."
ADVICE_SURGERY = "Primary surgery recommended before adjuvant therapy decision."
LABELS = {
    "low": ("低危", "Low Risk"),
    "intermediate": ("中危", "Intermediate Risk"),
    "high-intermediate": ("中高危", "High-Intermediate Risk"),
    "high": ("高危", "High Risk"),
    "unknown": ("不确定风险", "Uncertain Risk"),
}
COMORBIDITIES = ["glycemic_status", "bmi_status", "anemia", "hypertension", "hyperlipidemia", "hepatic_viral", "hepatic_dysfunction", "major_cv_risk", "hpv_status"]


def advice(surgery_done: Column | None = None) -> Column:
    out = F.lit(ADVICE_NONE)
    for group, text in ADVICE.items():
        out = F.when(_c("risk_group") == group, text).otherwise(out)
    out = F.when((_c("risk_group") == "High") & (_c("molecular_subtype") == "MMRd") & _c("stage_2023").startswith("III"), ADVICE_MMRD).otherwise(out)
    return out if surgery_done is None else F.when(~surgery_done, ADVICE_SURGERY).otherwise(out)


def risk_label(english: bool = True) -> Column:
    low, out = F.lower("risk_group"), F.lit(LABELS["unknown"][english])
    for key, names in LABELS.items():
        out = F.when(low == key, names[english]).otherwise(out)
    return out


def comorbidity_rows(patients: DataFrame) -> DataFrame:
    """(id, comorbidity, value) of those present."""
    return patients.select("id", *[_c(k).cast("int").alias(k) for k in COMORBIDITIES]).unpivot("id", COMORBIDITIES, "comorbidity", "value").filter("value > 0")


def overrides() -> Column:
    """Reasons for a board discussion."""
    return F.filter(F.array(F.when(_c("major_cv_risk") > 0, "major_cv_risk"), F.when(_c("age") >= 75, "age")), lambda x: x.isNotNull())
