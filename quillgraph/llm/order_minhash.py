"""Document fingerprints by Order MinHash.

Each k-mer of a text is numbered by its occurrence (how often the same k-mer
stood before), so that repeats count. The hashes of the numbered k-mers are
dealt to BINS sketches; each sketch selects its L minimal ones, puts them back
into text order and hashes the tuple. Texts that share k-mers in another order
thus differ, and the share of equal sketches follows edit distance.

The likeness of two fingerprints is the number of equal sketches among those
that at least one text fills: 1 for equal texts, about 0 for unrelated ones.

One hash of each k-mer serves all sketches: its leading bits name the sketch, the
rest rank it there, so a text needs one pass and not BINS. A sketch that a short
text leaves empty counts in a likeness only if the other text fills it.

Defined results: a null text counts as empty. An empty text fills no sketch:
its fingerprint is all zeros, and its likeness is 1 to another empty text and
0 to any other. Texts shorter than K are one k-mer. A doc_id of null comes
first in the order; rows of one doc_id follow each other by text, so repeated
rows are neighbours, and equal rows (ties) get results in either order. Very long
texts are hashed whole, in memory of about 60 bytes a code point. Other columns
are not read. The next document of the last one is the first. An empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import bound_batches, mix, partitions, powers, text_bytes

K, L, BINS = 8, 2, 64
#: Text of a range of documents, where the session's number of partitions does not make smaller ones.
BUCKET = 256 << 20
_BASE = 0xC2B2AE3D27D4EB4F
_POWERS = powers(_BASE, K)
_ORDER = [np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)]


def fingerprint(text: str | None) -> np.ndarray:
    """BINS 16-bit tuple hashes; 0 for a sketch without k-mers."""
    out = np.zeros(BINS, np.uint16)
    points = np.frombuffer((text or "").encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(points)
    if not n:
        return out
    if n < K:
        points = np.concatenate((points, np.zeros(K - n, np.uint64)))
    count = len(points) - K + 1
    grams = points[:count] * _POWERS[0]
    for i in range(1, K):
        grams += points[i : i + count] * _POWERS[i]
    grams = mix(grams)
    # equal k-mers stand together, in text order
    order = np.argsort(grams, kind="stable")
    key = grams[order]
    new = np.ones(count, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    index = np.arange(count)
    nth = index - np.maximum.accumulate(np.where(new, index, 0))
    numbered = mix(key + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    # each sketch's minimal hashes come first among those that share its leading bits
    line = np.argsort(numbered)
    small, at = numbered[line], order[line]
    edges = np.searchsorted(small, np.arange(BINS, dtype=np.uint64) << np.uint64(58))
    ends = np.append(edges[1:], count)
    full, two = edges < ends, edges + 1 < ends
    i, j = np.where(full, edges, 0), np.where(two, edges + 1, 0)
    first, second = small[i], np.where(two, small[j], np.uint64(0))
    swap = two & (at[j] < at[i])
    a, b = np.where(swap, second, first), np.where(swap, first, second)
    tuples = mix(a * _ORDER[0] + mix(b * _ORDER[1] + np.uint64(1)))
    out[full] = (tuples[full] % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal sketches among those that one of both fills."""
    filled = (a != 0) | (b != 0)
    return float(((a == b) & filled).sum() / filled.sum()) if filled.any() else 1.0


def edited(text: str, after: str) -> str:
    """text with its last half replaced by as many first code points of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def _compare(batches):
    """Rows come in order, those of a bucket together; a row is compared with the one after it. Copies are only compared with."""
    held = None  # bucket, doc_id, text, fingerprint

    def rows(batch):
        nonlocal held
        out = []
        for bucket, doc_id, text, copy in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            text = text or ""
            print_ = held[3] if held and held[2] == text else fingerprint(text)
            if held and held[0] == bucket:
                before = held[2]
                changed = edited(before, text)
                other = held[3] if changed == before else fingerprint(changed)
                out.append((held[1], len(before), hashlib.sha256(changed.encode()).hexdigest(), held[3].astype(">u2").tobytes().hex(), other.astype(">u2").tobytes().hex(), likeness(held[3], other), likeness(held[3], print_)))
            held = None if copy else (bucket, doc_id, text, print_)
        return out

    for batch in batches:
        for first in range(0, len(batch), 512):
            found = rows(batch.slice(first, 512))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), pa.schema([("d", pa.int64()), ("n", pa.int64()), ("s", pa.string()), ("f", pa.string()), ("e", pa.string()), ("a", pa.float64()), ("b", pa.float64())]), strict=True)], names=_OUT.fieldNames())


def _place(cuts: list[int], key: str) -> Column:
    """How many of the cuts are below the key: first among every few of them, then between two of these."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    array = lambda xs: "array(" + ", ".join(f"{c}L" if c > -(1 << 63) else "bigint(-9223372036854775807) - 1L" for c in xs) + ")"
    whole = f"size(filter({array(cuts[step - 1 :: step]) if len(cuts) >= step else 'array(9223372036854775807L)'}, c -> c < {key}))"
    rows = f"array({', '.join(array(cuts[i : i + step]) for i in range(0, len(cuts), step))}, array(9223372036854775807L))"
    return F.expr(f"{step} * {whole} + size(filter(element_at({rows}, {whole} + 1), c -> c < {key}))")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness to the text and to the next document.

    Documents are cut into buckets of consecutive doc_ids. The first document
    of each bucket is copied to the end of the bucket before it (one row a
    bucket; the last bucket gets the first document of all), so one exchange of
    the texts brings every document together with its next one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bound_batches(spark)
    n = max(1, partitions(spark), text_bytes(docs) // BUCKET)
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    cuts = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 10_000).alias("c")).first()["c"] or []
    ranged = docs.withColumn("bucket", _place(sorted(set(cuts)) if n > 1 else [], "coalesce(doc_id, bigint(-9223372036854775807) - 1L)"))
    firsts = ranged.groupBy("bucket").agg(F.min(key).alias("least")).orderBy("bucket").collect()
    if not firsts:
        return spark.createDataFrame([], _OUT)
    back = spark.createDataFrame([(r["least"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)], "least long, to int")
    copies = docs.withColumn("least", key).join(F.broadcast(back), "least").select(F.col("to").alias("bucket"), "doc_id", "text", F.lit(True).alias("copy"))
    both = ranged.select("bucket", "doc_id", "text", F.lit(False).alias("copy")).unionByName(copies)
    line = both.repartition(n, "bucket").sortWithinPartitions("bucket", "copy", F.col("doc_id").asc_nulls_first(), "text")
    return line.mapInArrow(_compare, _OUT)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and of its edited text."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
