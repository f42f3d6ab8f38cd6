"""Target-distribution importance resampling: documents drawn by how their hashed n-grams look to the target.

Features are runs of consecutive words, hashed to buckets. A bucket's gain is
the rounded log ratio of its shares in the target and in all documents; a
document's weight is the sum of its features' gains. Adding Gumbel noise that
depends on seed and doc_id and taking the highest scores draws without
replacement in proportion to exp(weight).

Texts are read once: a task hashes all words of a batch with array operations
and writes each document's buckets as packed numbers. Bucket counts and weights
then come from these, the counts as one array a task, the gains as one array of
all buckets. The k-th score is found by radix selection over digits of (score,
doc_id, n_features, row), without sorting anything; only rows that are drawn
are range-sorted and numbered. Hot keys don't exist: no step groups rows by a
value of theirs but by bucket (counts are summed before the shuffle) or digit.

Defined results: a null or empty text has no words, no features and weight 0.
Words longer than a vector pass of the checksum are hashed one by one, texts
are read whole. A null doc_id counts as the empty text in the hash and comes
last among equal scores. Rows that share an id are drawn one by one; rows that
are equal in score and doc_id (ties) are ordered by n_features, and beyond that
they are interchangeable. Other columns are ignored, those named like an output
included. An empty table gives an empty table; an empty target leaves t = 0.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import bound_batches, buffers, doc_slices, written
from quillgraph.llm.ordering import kth, numbered, within

#: Longest run of words, buckets, seed of the noise, words that a drawn document has at least, percentage that is drawn.
LONGEST, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Bytes of text that are hashed at a time, features likewise, and the bytes of a feature that array passes go through.
SLICE, SPANS, DEEP = 2 << 20, 1 << 19, 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, small letters and all of non-ASCII characters.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    """What a byte does to the checksum: eight steps of the reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each raw[start:end]: one array pass a byte, over the spans that have so many."""
    out = np.empty(len(starts), np.uint32)
    for i in range(0, len(starts), SPANS):
        s, n = starts[i : i + SPANS], (ends - starts)[i : i + SPANS]
        order = np.argsort(-n, kind="stable")
        s, n = s[order], n[order]
        state = np.full(len(s), 0xFFFFFFFF, np.uint32)
        more = np.searchsorted(-n, -np.arange(min(DEEP, int(n[0]) if len(n) else 0)), side="left")  # spans with more than so many bytes
        for p, m in enumerate(more):
            state[:m] = _CRC[(state[:m] ^ raw[s[:m] + p]) & 0xFF] ^ (state[:m] >> 8)
        state ^= np.uint32(0xFFFFFFFF)
        for j in range(int(np.searchsorted(-n, -DEEP, side="left"))):
            state[j] = zlib.crc32(raw[s[j] : s[j] + n[j]].tobytes())
        out[i + order] = state
    return out


def _words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words joined by a byte, starts, ends, words of each document); a document's words follow each other."""
    low = _LOWER[raw]
    inside = _INSIDE[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True
    before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before[: len(low)] | edge[:-1]))
    ends = np.flatnonzero(inside & (~after[: len(low)] | edge[1:])) + 1
    return low, starts, ends, np.diff(np.searchsorted(starts, off))


def _joined(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same words with one space between neighbours."""
    n = ends - starts
    first = np.cumsum(n + 1) - (n + 1)
    out = np.full(int((n + 1).sum()), 0x20, np.uint8)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(first, n) + at] = low[np.repeat(starts, n) + at]
    return out, first, first + n


def document_buckets(raw: np.ndarray, off: np.ndarray, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features, document by document; words and features of each document)."""
    found, n_words, n_features = [], [], []
    for i, j in doc_slices(off, SLICE):
        low, starts, ends, words = _words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        if longest > 1:
            low, starts, ends = _joined(low, starts, ends)
        owner = np.repeat(np.arange(j - i), words)
        hashes, owners = [], []
        for n in range(1, longest + 1):
            whole = np.flatnonzero(owner[: max(0, len(owner) - n + 1)] == owner[n - 1 :])  # runs within a document
            hashes.append(crc32_spans(low, starts[whole], ends[whole + n - 1]) % buckets)
            owners.append(owner[whole])
        order = np.argsort(np.concatenate(owners), kind="stable") if longest > 1 else slice(None)
        found.append(np.concatenate(hashes)[order].astype(np.uint32))
        n_words.append(words)
        n_features.append(sum(np.bincount(o, minlength=j - i) for o in owners))
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(found or [np.zeros(0, np.uint32)]), np.concatenate(n_words or empty), np.concatenate(n_features or empty)


def hashed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets): the packed buckets of each whole text."""
    bound_batches(docs.sparkSession)
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches):
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            found, words, features = document_buckets(raw, off, longest, buckets)
            cuts = np.concatenate(([0], np.cumsum(features))) * kind.itemsize
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(cuts.astype("<i8").tobytes()), pa.py_buffer(found.astype(kind).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(features, pa.int64()), packed.cast(pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(packed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket has; as many numbers as buckets reach the driver."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for frame in batches:
            for blob in frame["buckets"]:
                total += np.bincount(np.frombuffer(blob, kind), minlength=buckets)
        met = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": met.astype(np.int32), "n": total[met]})

    out = np.zeros(buckets, np.int64)
    for r in packed.select("buckets").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the documents)) of each bucket, one added to each count."""
    b, all_s, all_t = len(documents), int(documents.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(all_s + b) / (float(s + 1) * float(all_t + b)))) for s, t in zip(documents.tolist(), target.tolist(), strict=True)], np.int64)


def scored(packed: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """packed's rows with weight and score."""
    kind = np.dtype("<u2" if len(gain) <= 1 << 16 else "<u4")

    def run(batches):
        for batch in batches:
            raw, off = buffers(batch.column("buckets"))
            sums = np.concatenate(([0], np.cumsum(gain[raw.view(kind)])))[off // kind.itemsize]
            weight = np.diff(sums)
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in batch.column("h").to_pylist()]
            rest = [batch.column(c) for c in ("doc_id", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(weight, pa.int64()), pa.array(weight + np.array(noise, np.int64), pa.int64())], ["doc_id", "n_words", "n_features", "weight", "score"])

    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return packed.withColumn("h", F.conv(F.substring(mark, 1, 8), 16, 10).cast("long")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs; target needs a column text."""
    packed = written(hashed(docs, "doc_id", "text", longest, buckets), "importance-buckets")
    wanted = target.select(F.lit(0).alias("doc_id"), "text")
    gain = gains(bucket_counts(packed, buckets), bucket_counts(hashed(wanted, longest=longest, buckets=buckets), buckets))
    rows = scored(packed, gain, seed).withColumn("_row", F.monotonically_increasing_id())
    keys = {"_a": F.bitwise_not("score"), "_b": F.col("doc_id").isNull().cast("long"), "_c": F.coalesce("doc_id", F.lit(0)), "_d": F.col("n_features"), "_e": F.col("_row")}
    rows = written(rows, "importance-scores").withColumns(keys)
    may = F.col("n_words") >= least_words
    k = rows.filter(may).count() * percent // 100
    if not k:
        return rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    drawn = may & within(kth(rows.filter(may), list(keys), k))
    columns = ["doc_id", "n_features", "weight", "score"]
    first = numbered(rows.filter(drawn).select(*columns, *keys), list(keys), "rank", "importance-drawn").withColumn("rank", F.col("rank") + 1)
    return first.select(*columns, "rank").unionByName(rows.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with their weights towards ``benchmark`` and the ranks of those drawn."""
    return resample(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BYTE = "list_transform(range(octet_length(encode(w))), lambda i: 16 * (instr('0123456789ABCDEF', substr(hex(w), 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(w), 2 * i + 2, 1)) - 1)"
_HEX = " + ".join(f"{16 ** (7 - i)} * (instr('0123456789abcdef', substr(x, {i + 1}, 1)) - 1)" for i in range(8))

#: The checksum is computed from its table, once for each distinct word.
ORACLE_SQL = f"""
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
words AS MATERIALIZED (SELECT doc_id, NULL AS item_id, unnest(regexp_extract_all(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents
    UNION ALL SELECT NULL, item_id, unnest(regexp_extract_all(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
sums AS MATERIALIZED (SELECT w, xor(list_reduce([4294967295] || {_BYTE}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % {BUCKETS} AS b FROM (SELECT DISTINCT w FROM words) CROSS JOIN tab),
counts AS (SELECT b, count(doc_id) AS s, count(item_id) AS t FROM words JOIN sums USING (w) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * ((SELECT sum(s) FROM counts) + {BUCKETS}) / (CAST(s + 1 AS DOUBLE) * ((SELECT sum(t) FROM counts) + {BUCKETS})))) AS BIGINT) AS g FROM counts),
weights AS (SELECT doc_id, count(*) AS n, sum(g) AS weight FROM words JOIN sums USING (w) JOIN gain USING (b) WHERE doc_id IS NOT NULL GROUP BY doc_id),
noise AS (SELECT doc_id, {_HEX} AS h FROM (SELECT doc_id, sha256('{SEED}:' || doc_id) AS x FROM documents)),
scores AS (SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM noise LEFT JOIN weights USING (doc_id)),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores WHERE n_features >= {LEAST_WORDS} QUALIFY rank <= {PERCENT} * count(*) OVER () // 100)
SELECT doc_id, n_features, weight, score, rank FROM scores LEFT JOIN ranks USING (doc_id)"""
