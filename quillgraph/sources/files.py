"""Readers and writers of files: JSON, documents as binary files, graphs in XML."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A JSON object or array of objects a file."""
    return spark.read.json(path, schema=schema, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One object a line; blank lines are skipped."""
    return spark.read.json(path, schema=schema)


def docx_text(content: bytes) -> str:
    """Paragraphs and table rows of a Word file; a cell equal to the one before (merged cells) counts once."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    out = []
    for e in body if body is not None else []:
        if e.tag == f"{w}p":
            out.append(words(e))
        elif e.tag == f"{w}tbl":
            for row in e.findall(f"{w}tr"):  # rows of a table in a cell belong to that cell
                cells = [words(c) for c in row.findall(f"{w}tc")]
                out.append(" | ".join(c for k, c in enumerate(cells) if c and (k == 0 or c != cells[k - 1])))
    return "\n".join(x for x in out if x)


def pdf_text(content: bytes) -> str:
    """Strings of text operators of a PDF, where its streams are plain or deflated."""
    import zlib

    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        for block in re.findall(rb"BT(.*?)ET", data, re.S):
            out.append("".join(re.sub(rb"\\(.)", rb"\1", s).decode("latin-1") for s in re.findall(rb"\(((?:\\.|[^\\()])*)\)", block, re.S)))
    return "\n".join(out)


def read_folder(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(id, file_path, type, raw_text, text_length, status) of PDF and DOCX files."""

    @F.pandas_udf("struct<raw_text string, status string>")
    def read(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for k, c in zip(kind, content, strict=True):
            try:
                text = docx_text(c) if k == "DOCX" else pdf_text(c)
                rows.append((text, "ok" if text else "warning: no text"))
            except Exception as e:  # noqa: BLE001  a broken file is a row of its own
                rows.append(("", f"error: {e}"))
        return pd.DataFrame(rows, columns=["raw_text", "status"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.upper(F.element_at(F.split(name, r"\."), -1))
    rows = files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("id"), F.col("path").alias("file_path"), kind.alias("type"), "content").filter(F.col("type").isin("PDF", "DOCX"))
    return rows.withColumn("_r", read("type", "content")).select("id", "file_path", "type", F.col("_r.raw_text").alias("raw_text"), F.length("_r.raw_text").alias("text_length"), F.col("_r.status").alias("status"))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML by the built-in XML source, quotes stripped; attributes by data key."""
    bare = lambda c: F.expr(f"trim(BOTH '\"' FROM {c})")

    def rows(tag: str, attributes: list[str], keys: dict[str, str]) -> DataFrame:
        schema = ", ".join([*(f"_{a} string" for a in attributes), "data array<struct<_VALUE: string, _key: string>>"])
        df = spark.read.format("xml").option("rowTag", tag).schema(schema).option("recursiveFileLookup", "true").option("ignoreSurroundingSpaces", "false").load(path)
        found = lambda k: F.try_element_at(F.transform(F.filter("data", lambda d: d["_key"] == k), lambda d: d["_VALUE"]), F.lit(1))
        return df.select(*[bare(f"_{a}").alias(a) for a in attributes], *[F.regexp_replace(found(k), '^"+|"+$', "").alias(n) for k, n in keys.items()])

    nodes = rows("node", ["id"], NODE_KEYS)
    edges = rows("edge", ["source", "target"], EDGE_KEYS)
    return nodes, edges.withColumn("weight", F.col("weight").try_cast("double"))


#: Attributes of a node and an edge with the keys that GraphML files name them by.
NODE_KEYS = {"d0": "entity_type", "d1": "description", "d2": "source_id"}
EDGE_KEYS = {"d3": "weight", "d4": "description", "d5": "keywords", "d6": "source_id"}


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes(id, ...) and edges(source, target, ...) as GraphML, a file a part and table, by the built-in XML sink; attributes that are null are left out.

    Each file has the elements of one part; ``read_graphml`` reads them all.
    """

    def write(df: DataFrame, tag: str, attributes: list[str], keys: dict[str, str], kind: str) -> None:
        data = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), F.struct(F.lit(k).alias("_key"), F.col(n).cast("string").alias("_VALUE"))) for k, n in keys.items())))
        rows = df.select(*(F.col(a).cast("string").alias(f"_{a}") for a in attributes), data.alias("data"))
        declared = 'graphml xmlns="http://graphml.graphdrawing.org/xmlns"'
        rows.write.format("xml").option("rootTag", declared).option("rowTag", tag).option("declaration", 'version="1.0" encoding="UTF-8"').mode("overwrite").save(f"{path}/{kind}")

    write(nodes, "node", ["id"], NODE_KEYS, "nodes")
    write(edges, "edge", ["source", "target"], EDGE_KEYS, "edges")


def write_graphml_tables(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of an outside database; needs its driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
