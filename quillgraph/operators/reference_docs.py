"""Reference documents: sections of markdown texts and keyword search in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import strip

PREAMBLE = "概述"


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, heading, content): parts that start with ``## ``; what stands before is the preamble."""
    parts = docs.select("doc_id", F.posexplode(F.split(text, r"(?m)^## ")).alias("pos", "part"))
    lines = F.split("part", "\n", 2)
    heading = F.when(F.col("pos") == 0, PREAMBLE).otherwise(strip(lines[0]))
    content = F.when(F.col("pos") == 0, strip(F.col("part"))).otherwise(strip(F.coalesce(F.get(lines, F.lit(1)), F.lit(""))))
    return parts.select("doc_id", "pos", heading.alias("heading"), content.alias("content")).filter((F.col("pos") > 0) | (F.col("content") != ""))


def keyword_lines(docs: DataFrame, keyword: str, text: str = "text") -> DataFrame:
    """(doc_id, line_no, snippet): each line with the keyword, with one line before and two after."""
    lines = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    near = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(-1, 2)
    hit = F.lower("line").contains(keyword.lower())
    return lines.withColumn("snippet", F.array_join(F.collect_list("line").over(near), "\n")).filter(hit).select("doc_id", "line_no", "snippet")


def keyword_sections(secs: DataFrame, keywords: list[str]) -> DataFrame:
    """Sections with any keyword; all of a document that has none."""
    hit = F.exists(F.array(*map(F.lit, keywords)), lambda k: F.lower("content").contains(F.lower(k)))
    marked = secs.withColumn("_hit", hit).withColumn("_any", F.max(F.col("_hit").cast("int")).over(Window.partitionBy("doc_id")))
    return marked.filter(F.col("_hit") | (F.col("_any") == 0)).drop("_hit", "_any")


def section_of(secs: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, doc_id, content) of asked(id, doc_id, title): the section of that heading, else the first whose heading has it in any case."""
    both = asked.join(secs, "doc_id").withColumn("_exact", F.col("heading") == F.col("title"))
    near = both.filter(F.col("_exact") | F.contains(F.lower("heading"), F.lower("title")))
    return near.groupBy("id", "doc_id").agg(F.min_by("content", F.struct((~F.col("_exact")).cast("int"), "pos")).alias("content"))


def summary(text: Column, most: int = 500) -> Column:
    """The first characters, marked where there are more."""
    return F.concat(F.left(text, F.lit(most)), F.when(F.length(text) > most, "...").otherwise(""))
