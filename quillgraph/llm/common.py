"""Shared plumbing of the training-data operators: Arrow buffers, hashing, blocks and shared tables."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.session import bound_batches, shuffles_dropped  # noqa: F401

#: White space as the contracts define it: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64


def _give_back() -> None:
    """Large arrays go back to the system when they are freed, not into the process's own pool (glibc; elsewhere nothing changes)."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)
        libc.mallopt(-1, 32 << 20)


_give_back()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where the session names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, lineage cut, safe from lost executors; its shuffle files go once it is there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave and that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts (null: none)."""
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as (bytes, n + 1 offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def lower_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of ASCII-lowered texts: (lowered bytes, starts, ends, document of each word).

    No word crosses a document border.
    """
    low = _LOWER[raw]
    inside = ~_IS_SPACE[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(low) else np.zeros(0, bool)
    after = np.concatenate((inside[1:], [False])) if len(low) else np.zeros(0, bool)
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return low, starts, ends, owner


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], equal for equal bytes wherever they stand."""
    n = len(raw)
    sums = np.zeros(n + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * powers(_BASE, n), out=sums[1:])
    inverse = powers(_BASE_INV, n + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def doc_slices(offsets: np.ndarray, most: int):
    """(first, last) runs of documents of at most ``most`` bytes together, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def in_blocks(docs: DataFrame, columns: list[str], n_blocks: int) -> DataFrame:
    """columns of docs with ``block`` (a hash of doc_id, of the text where there is none), the rows of a block together."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    salted = docs.select(F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int").alias("block"), *columns)
    return salted.repartition(partitions(docs.sparkSession), "block")


def packed(groups: np.ndarray, values: np.ndarray, n_groups: int) -> list[tuple[int, bytes]]:
    """(group, its values as bytes) for each group that has some, values kept in their order."""
    order = np.argsort(groups, kind="stable")
    values = values[order]
    cuts = np.searchsorted(groups[order], np.arange(n_groups + 1))
    return [(g, values[cuts[g] : cuts[g + 1]].tobytes()) for g in range(n_groups) if cuts[g + 1] > cuts[g]]
