"""Training-data curation and text assembly around retrieval."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import strip
from quillgraph.session import materialise


def first_match(ranked: DataFrame, signals: list[str], top: int = 5) -> DataFrame:
    """(query_id, name): the first of the ``top`` names that has a signal word, else the first."""
    hit = F.exists(F.array(*map(F.lit, signals)), lambda s: F.lower("name").contains(s))
    return ranked.filter(F.col("rank") < top).groupBy("query_id").agg(F.min_by("name", F.struct((~hit).cast("int"), "rank")).alias("name"))


def hard_negatives(anchors: DataFrame, facts: DataFrame, per_anchor: int = 3) -> DataFrame:
    """(anchor_id, hyperedge): of a few recommendations of each topic of facts(hyperedge, topic, role) those for another topic, in a fixed hash order.

    ``hard_negatives_of_all`` chooses among all of them.
    """
    other = anchors.select("anchor_id", F.col("topic").alias("_t"))
    by_topic = facts.filter("role = 'RECOMMENDATION'").select("hyperedge", "topic").distinct()
    # a few of each topic are enough for any anchor: what meets is bounded before the join
    line = Window.partitionBy("topic").orderBy(F.md5(F.col("hyperedge").cast("string")), "hyperedge")
    few = by_topic.withColumn("_r", F.row_number().over(line)).filter(F.col("_r") <= per_anchor).drop("_r")
    # one row with all of them meets each anchor where it is read, which keeps its first ones; else anchors would go to the few's one task
    all_ = few.agg(F.collect_list(F.struct("hyperedge", "topic")).alias("_few"))
    order = lambda x: F.struct(F.md5(F.concat_ws(":", "anchor_id", x["hyperedge"])).alias("_h"), x["hyperedge"].alias("hyperedge"))
    own = F.slice(F.array_sort(F.transform(F.filter("_few", lambda x: x["topic"] != F.col("_t")), order)), 1, per_anchor)
    pairs = other.crossJoin(F.broadcast(all_)).select("anchor_id", F.explode(own).alias("_x")).select("anchor_id", "_x.*")
    pick = Window.partitionBy("anchor_id").orderBy("_h", "hyperedge")
    return pairs.withColumn("_r", F.row_number().over(pick)).filter(F.col("_r") <= per_anchor).select("anchor_id", "hyperedge")


#: Rows of either side of a block of anchors and candidates that one task goes through.
MET = 4096


def hard_negatives_of_all(anchors: DataFrame, facts: DataFrame, per_anchor: int = 3) -> DataFrame:
    """(anchor_id, hyperedge): of all recommendations of facts(hyperedge, topic, role) for another topic the first in the anchor's own hash order.

    Each anchor meets each candidate, so time grows with their product; blocks
    of both meet in a task each. Only hashes under a bound, which some more than
    ``per_anchor`` should pass, leave a task. Anchors with fewer meet all
    candidates again without it.
    """
    own = anchors.select("anchor_id", F.col("topic").alias("_t"))
    every = materialise(facts.filter("role = 'RECOMMENDATION'").select("hyperedge", "topic").distinct(), "candidates")
    sizes = every.groupBy("topic").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    total, others = sizes["n"] or 0, (sizes["n"] or 0) - (sizes["most"] or 0)
    wanted = per_anchor + 6 * per_anchor**0.5 + 12
    bound = f"{int(wanted / others * 2**32):08x}" if others > 4 * wanted else None

    def met(left: DataFrame, bound: str | None) -> DataFrame:
        na, nc = (max(1, -(-n // MET)) for n in (left.count(), total))
        block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        a = left.select("anchor_id", "_t", F.concat(F.col("anchor_id").cast("string"), F.lit(":")).alias("_x"), block("anchor_id", na).alias("_a"), each(nc).alias("_c"))
        c = every.select("hyperedge", "topic", F.col("hyperedge").cast("string").alias("_y"), block("hyperedge", nc).alias("_c"), each(na).alias("_a"))
        a, c = (x.repartition(min(2 * na * nc, 10_000), "_a", "_c") for x in (a, c))
        pairs = a.join(c, ["_a", "_c"]).filter("_t <> topic").select("anchor_id", "hyperedge", F.md5(F.concat("_x", "_y")).alias("_h"))
        return pairs if bound is None else pairs.filter(F.col("_h") < bound)

    line = Window.partitionBy("anchor_id").orderBy("_h", "hyperedge")
    first = lambda pairs: pairs.withColumn("_r", F.row_number().over(line)).filter(F.col("_r") <= per_anchor)
    found = materialise(first(met(own, bound)), "hard-negatives")
    if bound is not None:
        full = found.filter(F.col("_r") == per_anchor).select("anchor_id")
        short = materialise(own.join(full, "anchor_id", "left_anti").filter("_t IS NOT NULL"), "short-anchors")
        if not short.isEmpty():
            found = found.join(full, "anchor_id", "left_semi").unionByName(first(met(short, None)))
    return found.select("anchor_id", "hyperedge")


def redirected(evidence: DataFrame, sources: DataFrame, bodies: list[str]) -> DataFrame:
    """evidence(id, source, body) with ``final_source``: an authoritative source stays; others go to the body's own paper, the shortest title of those named after it."""
    ours = F.exists(F.array(*map(F.lit, bodies)), lambda b: F.upper("source").contains(b))
    named = sources.select(F.explode(F.filter(F.array(*map(F.lit, bodies)), lambda b: F.upper("title").contains(b))).alias("body"), "title")
    best = named.groupBy("body").agg(F.min_by("title", F.struct(F.length("title"), "title")).alias("_best"))
    return evidence.join(best, "body", "left").withColumn("final_source", F.when(ours, F.col("source")).otherwise(F.coalesce("_best", "source"))).drop("_best")


# Other spellings of keywords.
ALIASES = {
    "Stage IA": "IA", "Stage IB": "IB", "Stage IIIA": "IIIA", "Stage IIIA1": "IIIA1",
    "I级": "G1", "II级": "G2", "III级": "G3", "高分化": "G1", "中分化": "G2", "低分化": "G3",
    "MMR正常": "pMMR", "MMR缺失": "dMMR", "阴性": "-", "阳性": "+",
}


def keywords(c: Column, fallback: Column, risk: Column | None = None) -> Column:
    """Distinct keywords of lines of comma lists; without any the fallback's first 200 characters.

    A line's label ends at its colon. The risk comes last. ``Stage`` in front
    and a final 期 are stripped, then aliases resolved.
    """
    body = lambda x: F.when(x.contains("]") & x.contains(":"), F.regexp_replace(x, "^[^:]*:", "")).otherwise(x)
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.split(body(strip(x)), "[,，]"))
    words = F.flatten(lines)
    words = F.concat(words, F.array(F.coalesce(risk, F.lit("")))) if risk is not None else words
    words = F.filter(F.transform(words, strip), lambda x: x != "")
    lookup = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)^Stage\s*", ""), "期$", "")
    clean = F.array_distinct(F.transform(words, lambda x: F.coalesce(F.try_element_at(lookup, bare(x)), bare(x))))
    return F.when(F.size(clean) > 0, clean).otherwise(F.array(F.left(fallback, F.lit(200))))


_KEYWORDS = "struct<high_level_keywords: array<string>, low_level_keywords: array<string>>"


def keyword_json(c: Column) -> Column:
    """Both keyword lists of a reply: the whole text as JSON, else what stands between its braces, else empty lists."""
    schema = "high_level_keywords array<string>, low_level_keywords array<string>"
    whole, inner = F.from_json(c, schema), F.from_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1), schema)
    empty = F.array().cast("array<string>")
    get = lambda k: F.coalesce(whole[k], inner[k], empty)
    return F.struct(get("high_level_keywords").alias("high"), get("low_level_keywords").alias("low"))


def mean_pooled(tokens: DataFrame) -> DataFrame:
    """(id, vector): element-wise mean of tokens(id, vector) rows."""
    each = tokens.select("id", F.posexplode("vector").alias("i", "x")).groupBy("id", "i").agg(F.avg("x").alias("x"))
    return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def combined_contexts(contexts: DataFrame) -> DataFrame:
    """(query_id, number, content) of contexts(query_id, list_no, pos, content): ordered, each content once, numbered from 1."""
    first = contexts.groupBy("query_id", "content").agg(F.min(F.struct("list_no", "pos")).alias("_p"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("_p"))).select("query_id", "number", "content")


def patient_text() -> Column:
    """A line that describes a patient; the 2023 stage where it is known."""
    stage = F.when(F.col("stage_2023") != "unknown", F.col("stage_2023")).otherwise(F.col("stage_raw"))
    return F.concat_ws("; ", F.concat(F.lit("age "), "age"), F.concat(F.lit("histology "), "histology_type"), F.concat(F.lit("grade "), "grade"), F.concat(F.lit("stage "), stage), F.when(F.col("molecular_subtype") != "unknown", F.concat(F.lit("class "), "molecular_subtype")))


def alarm_fusion(graph: Column, neural: Column, tier: Column, alarm: Column) -> Column:
    """Alarms first; 0.7 graph and 0.3 neural where the graph has a score, else neural alone; plus a bonus for the tier."""
    return F.when(alarm, 1000.0).otherwise(0.0) + F.when(graph > 0, 0.7 * graph + 0.3 * neural).otherwise(neural) + (4 - tier) * 0.1


def node2vec(edges: DataFrame, dim: int = 16, walks: int = 4, length: int = 8, seed: int = 3) -> DataFrame:
    """(node, vector): Word2Vec over uniform walks; each step joins walks with neighbours and draws one by a seeded hash."""
    from pyspark.ml.feature import Word2Vec

    from quillgraph.operators.graph import undirected
    from quillgraph.session import materialise

    near = undirected(edges.select("src", "tgt")).groupBy("src").agg(F.array_sort(F.collect_set("tgt")).alias("near"))
    now = near.select(F.col("src").alias("at"), F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk")).withColumn("path", F.array(F.col("at").cast("string"))).withColumn("start", F.col("at"))
    for step in range(1, length):
        drawn = F.pmod(F.xxhash64("start", "walk", F.lit(step), F.lit(seed)), F.size("near")).cast("int")
        now = now.join(near, now["at"] == near["src"]).withColumn("at", F.get("near", drawn)).drop("src", "near")
        now = materialise(now.withColumn("path", F.array_append("path", F.col("at").cast("string"))), "walks")
    model = Word2Vec(vectorSize=dim, windowSize=2, minCount=0, seed=seed, inputCol="path", outputCol="v").fit(now)
    return model.getVectors().withColumnRenamed("word", "node")


def _csv_rows(texts: pd.Series) -> pd.Series:
    """Records of each CSV text but the header, all their fields but the first joined by commas; quoted line breaks belong to their field."""
    return texts.map(lambda t: [",".join(r[1:]) for r in list(csv.reader(io.StringIO((t or "").strip())))[1:] if r])


def contexts_of_csv(rows: DataFrame, column: str = "csv") -> DataFrame:
    """(query_id, list_no, pos, content) of rows(query_id, list_no, csv): what each record of a CSV text says, in order; empty ones drop out."""
    found = rows.select("query_id", "list_no", F.posexplode(F.pandas_udf(_csv_rows, "array<string>")(F.col(column))).alias("pos", "content"))
    return found.filter("content <> ''")
