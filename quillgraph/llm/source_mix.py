"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same number of copies c = target / size of
the source in expectation. floor(c) copies are certain; the fraction is decided
by pivotal rounding: two fractional probabilities meet, mass moves at random
from one to the other until one of them is 0 or 1, and the other goes on.
Documents meet in order of size within a chunk of their source; what is left
of the chunks (one fraction each at most) meets in a reduction tree until one
fraction a source is left, which a last draw decides. A source's number of
copies is thus fixed up to one, and since neighbours have like sizes so is
nearly its number of words.

Every row gets a number, ``_u``, made of all its columns and of its place among
rows that are equal in all of them; draws and chunks depend on these numbers
only, so reruns agree however the rows are dealt, and a source (or a null
doc_id) with a third of all rows is spread over all chunks.

Defined results: a null text has size 0 and takes no words. The null source is
a source of its own, ordered last. Repeated rows (or ids) are decided one by
one; rows equal in all columns (ties) are interchangeable. Columns of maps and
variants don't tell rows apart. Very long texts are counted whole. Other columns are kept; those named like an output are replaced. An empty
table gives an empty table.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import WORD, written

#: Rows of a chunk, and chunks that meet in one node of the reduction tree.
CHUNK_ROWS, FANOUT = 20_000, 64
#: Copies of a document at most; targets stop at as many times the size of the source.
MOST = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)

_UNIT = "source string, doc_id long, size long, _u long, p double, chunk long"


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``size``, the words of the whole text."""
    return docs.drop("size").withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row a source: source_size and target.

    Sources ordered by cap / weight: while the common share per weight of what
    is left reaches a source's cap, that source stops there; the first source
    that stays below sets the share of all the rest.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("_i", (F.row_number().over(order) - 1) % len(weights))
    by = by.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.col("_i") + 1).cast("double"))
    by = by.withColumn("_cap", (most * F.col("source_size")).cast("double"))
    line = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    until, rest = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumn("_total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    share = (F.col("_total") - F.coalesce(F.sum("_cap").over(until), F.lit(0.0))) / F.sum("_w").over(rest)
    by = by.withColumn("_share", share).withColumn("_stops", F.col("_share") * F.col("_w") >= F.col("_cap"))
    common = F.first(F.when(~F.col("_stops"), F.col("_share")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return by.select("source", "source_size", F.when(F.col("_stops"), F.col("_cap")).otherwise(common * F.col("_w")).alias("target"))


def _draw(a: int, b: int, level: int) -> float:
    """A number in [0, 1) that depends on the two that meet only."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + level * 0x165667B19E3779F9 + 0x27D4EB2F165667C5) & 0xFFFFFFFFFFFFFFFF
    for _ in range(2):
        x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 33)) >> 11) / (1 << 53)


def pivot(ids: list[int], p: list[float], level: int) -> list[float]:
    """p after all meetings in the given order: 0 or 1, but for one fraction at most."""
    out, eps = [float(x) for x in p], 1e-9
    held = -1
    for k, x in enumerate(out):
        if x <= eps or x >= 1 - eps:
            out[k] = float(round(x))
            continue
        if held < 0:
            held = k
            continue
        a, b = out[held], x
        u, total = _draw(ids[held], ids[k], level), a + b
        if total < 1 - eps:
            held, gone = (k, held) if u < b / total else (held, k)
            out[gone], out[held] = 0.0, total
        elif total <= 1 + eps:
            held, gone = (k, held) if u < b else (held, k)
            out[gone], out[held] = 0.0, 1.0
            held = -1
        else:
            full, held = (held, k) if u < (1 - b) / (2 - total) else (k, held)
            out[full], out[held] = 1.0, total - 1
    return out


def _meet(level: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "_u"], kind="stable")
        group["p"] = pivot(group["_u"].tolist(), group["p"].tolist(), level)
        return group

    return run


def numbered(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep of docs with ``size`` and ``_u``, a number for each row that depends on the rows only, not on their order."""
    told = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    hashed = sizes(docs.withColumn("_h", F.xxhash64(*told))).select(*(F.col(f"`{c}`") for c in keep), "_h")
    # rows that share a hash are equal in all columns that tell rows apart
    return hashed.withColumn("_u", F.xxhash64("_h", F.row_number().over(Window.partitionBy("_h").orderBy("_h")))).drop("_h")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each row of docs: doc_id, source, _u, size, source_size, target, copies, taken."""
    return _planned(numbered(docs, ["doc_id", "source", "size"]), weights, most)


def _planned(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    units = written(rows, "mix-units")
    goals = targets(units, weights, most)
    # no hint: Spark broadcasts the sources only while they are below its own size threshold
    planned = units.join(goals, units["source"].eqNullSafe(goals["source"]), "left").drop(goals["source"])
    planned = planned.withColumn("_c", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    planned = planned.withColumn("_sure", F.floor(F.col("_c") + 1e-9)).withColumn("p", F.greatest(F.col("_c") - F.col("_sure"), F.lit(0.0)))
    chunks = max(1, math.ceil(units.count() / CHUNK_ROWS))
    first = planned.select("source", F.col("doc_id").cast("long").alias("doc_id"), "size", "_u", "p", F.pmod(F.xxhash64("_u"), F.lit(chunks)).alias("chunk"))
    decided, level = [], 0
    while True:
        met = written(first.groupBy("source", "chunk").applyInPandas(_meet(level), _UNIT), f"mix-level{level}")
        whole = (F.col("p") == 0) | (F.col("p") == 1)
        decided.append(met.filter(whole))
        if chunks == 1:
            last = met.filter(~whole)
            u = F.pmod(F.xxhash64("_u", "source"), F.lit(1 << 30)) / (1 << 30)
            decided.append(last.withColumn("p", F.when(u < F.col("p"), 1.0).otherwise(0.0)))
            break
        chunks, level = math.ceil(chunks / FANOUT), level + 1
        first = met.filter(~whole).withColumn("chunk", F.floor(F.col("chunk") / FANOUT) % chunks)
    extra = decided[0]
    for more in decided[1:]:
        extra = extra.unionByName(more)
    sure = goals.select("source", "source_size", "target")
    done = extra.join(sure, extra["source"].eqNullSafe(sure["source"]), "left").drop(sure["source"])
    c = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = (F.floor(c + 1e-9) + F.col("p")).cast("long")
    done = done.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return done.select("doc_id", "source", "_u", "size", "source_size", F.col("target").cast("double").alias("target"), "copies", "taken")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixture itself: each row of docs as often as the plan takes it, with docs' columns."""
    rows = numbered(docs, docs.columns)
    taken = plan(docs, weights, most).filter(F.col("copies") > 0).select("_u", F.col("doc_id").alias("_id"), F.col("copies").alias("_copies"))
    both = rows.join(taken, (rows["_u"] == taken["_u"]) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")))
    repeated = both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*docs.columns)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all ``documents``: the words that it takes of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken")
