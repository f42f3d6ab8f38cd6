"""Containment joins: which texts contain which others, through the rarest sampled q-gram."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import bound_batches, materialise

#: Characters of a gram; shorter needles are filed whole.
GRAM = 16
#: Doublings of GRAM that longer needles use.
LEVELS = 3
#: Texts that a task has as Python strings at a time, grams of a part of the filter, and bits of a part and of the whole, powers of two.
SLICE, PART_GRAMS, PART_BITS, MOST_BITS = 256, 1 << 15, 1 << 19, 1 << 28
_BASE, _SIDE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a ^ (a >> np.uint64(29))) * _BASE + b * _SIDE
    return out ^ (out >> np.uint64(32))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    size = 1
    while size < w:
        step = min(size, w - size)
        x = np.minimum(x[:-step], x[step:])
        size += step
    return x


def gram_hashes(text: str, classes: list[int], gram: int = GRAM) -> np.ndarray:
    """64-bit hashes by which needles of these classes are filed, of a needle or of a text; some more than once.

    Up to ``gram`` these are the runs of n characters. Above, runs of half a
    class (at least ``gram``) are sampled: the least hash of each n characters,
    so all that a needle gives is given by each text that contains it.
    """
    points, out = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), [np.zeros(0, np.uint64)]
    runs, size = _mixed(points, points), 1  # of so many characters; longer ones from two that overlap
    for n in sorted(n for n in classes if n <= len(points)):
        own = n if n <= gram else max(gram, n // 2)
        while size * 2 <= own:
            runs, size = _mixed(runs[:-size], runs[size:]), size * 2
        found = _least(runs if own == size else _mixed(runs[: size - own], runs[own - size :]), n - own + 1)
        out.append(found[np.append(True, found[1:] != found[:-1])] if own < n else found)
    return np.concatenate(out).astype(np.int64)


def _class(length: int, gram: int) -> int:
    """The class of a needle: its length up to gram, then the largest of LEVELS doublings that it reaches."""
    return length if length <= gram else max(gram << i for i in range(LEVELS + 1) if gram << i <= length)


def _bits(grams: np.ndarray, turn: int, parts: int = 1) -> np.ndarray:
    """The place of one of three bits of a gram in a filter; the upper bits of sampled grams are small and not used."""
    at = (grams >> (9 + 13 * turn)) & (PART_BITS - 1)
    return at | ((grams & (parts - 1)) * PART_BITS) if parts > 1 else at


def bloom(grams: DataFrame) -> np.ndarray:
    """A Bloom filter of grams(gram), hashes, one row a part; at most MOST_BITS whatever their number, then it only lets more pass."""
    parts = min(1 << (grams.count() // PART_GRAMS).bit_length(), MOST_BITS // PART_BITS)

    def bits(key, rows):
        own = np.zeros(PART_BITS, np.uint8)
        for turn in range(3):
            own[_bits(rows.column("gram").to_numpy(), turn)] = 1
        return pa.table({"part": [key[0].as_py()], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    out = np.zeros((parts, PART_BITS // 8), np.uint8)
    for r in grams.withColumn("part", F.col("gram").bitwiseAND(parts - 1)).groupBy("part").applyInArrow(bits, "part long, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def passing(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The places of the hashes that may be among those of a Bloom filter."""
    found = np.arange(len(hashes))
    for turn in range(3):
        at = _bits(hashes[found], turn, len(wanted) * 8 // PART_BITS)
        found = found[(wanted[at >> 3] >> (at & 7)) & 1 > 0]
    return found


def _gram_rows(rows: DataFrame, text: str, gram: int, classes: list[int] | None = None, wanted: np.ndarray | None = None) -> DataFrame:
    """rows without text, with ``gram``: a row for each gram of the text's own class, or of classes among wanted ones; a slice of texts at a time."""
    rest = [c for c in rows.columns if c != text]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                held = []
                for t in part.column(text).to_pylist():
                    found = gram_hashes(t, classes or [_class(len(t), gram)], gram)
                    held.append(np.unique(found if wanted is None else found[passing(found, wanted)]))
                at = pa.array(np.repeat(np.arange(len(held)), [len(f) for f in held]))
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(at) for c in rest], pa.array(np.concatenate(held))], [*rest, "gram"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in rest) + ", gram long")


def _met(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """texts(text_id, text) that pass a filter of the pairs' ids where they are read, so hardly any other is shuffled."""
    wanted, kind = bloom(pairs.select(F.xxhash64("text_id").alias("gram")).distinct()), dict(texts.dtypes)["text_id"]

    def run(batches):
        for batch in batches:
            yield batch.take(pa.array(passing(batch.column(0).to_numpy(), wanted))).drop_columns(["h"])

    return texts.select(F.xxhash64("text_id").alias("h"), "text_id", "text").mapInArrow(run, f"text_id {kind}, text string")


def _pairs(needles: DataFrame, texts: DataFrame, gram: int) -> DataFrame:
    """What ``contained`` gives; rows that share an id can give a pair more than once."""
    bound_batches(texts.sparkSession)
    needles = materialise(needles.select("needle_id", "needle", F.length("needle").alias("_len"), F.xxhash64("needle").alias("_h")).filter("_len > 0"), "needles")
    texts = texts.select("text_id", "text").filter("text IS NOT NULL")
    longest = texts.agg(F.max(F.length("text")).alias("n")).first()["n"] or 0
    needles = needles.filter(F.col("_len") <= longest)
    top = gram << LEVELS
    # lengths beyond the highest class are one class, so there are few
    classes = sorted({_class(r["n"], gram) for r in needles.select(F.least("_len", F.lit(top)).alias("n")).distinct().collect()})
    if not classes:
        kinds = dict(needles.dtypes)["needle_id"], dict(texts.dtypes)["text_id"]
        return needles.sparkSession.createDataFrame([], f"needle_id {kinds[0]}, text_id {kinds[1]}")
    theirs = materialise(_gram_rows(needles.select("needle_id", "_h", "needle"), "needle", gram), "needle-grams")
    met = materialise(_gram_rows(texts, "text", gram, classes, bloom(theirs.select("gram").distinct())), "text-grams")
    counts = met.groupBy("gram").agg(F.count("*").alias("_n"))
    filed = theirs.join(counts, "gram", "left").groupBy("needle_id", "_h").agg(F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram"))
    pairs = materialise(filed.join(met, "gram").select("needle_id", "_h", "text_id").distinct(), "containment-pairs")
    own = needles.select("needle_id", "_h", "needle")
    return pairs.join(own, ["needle_id", "_h"]).join(_met(texts, pairs), "text_id").filter(F.col("text").contains(F.col("needle"))).select("needle_id", "text_id")


def contained(needles: DataFrame, texts: DataFrame, gram: int = GRAM) -> DataFrame:
    """(needle_id, text_id) of needles(needle_id, needle) that stand in texts(text_id, text), each pair once.

    A needle is filed under that one of its sampled grams which the fewest texts
    have; texts give the grams that pass a filter of those that needles have.
    They meet by an equi-join on the gram, and what meets is compared exactly,
    so hashes decide nothing. Longer needles have longer and fewer grams: a row
    for some 8 to 32 characters, so rows grow with the needles and with what
    texts share with them, not with all characters of the texts.
    Needles longer than the longest text stand nowhere. Needles
    shorter than a gram are a class of their own for each length, filed whole.
    Needles with a gram that no text has meet nothing; null and empty ones
    stand nowhere. Rows that share an id are compared one by one.
    """
    return _pairs(needles, texts, gram).distinct()


def either_way(left: DataFrame, right: DataFrame, gram: int = GRAM) -> DataFrame:
    """(left_id, right_id) of left(left_id, left) and right(right_id, right) where one contains the other."""
    there = _pairs(left.selectExpr("left_id AS needle_id", "left AS needle"), right.selectExpr("right_id AS text_id", "right AS text"), gram)
    back = _pairs(right.selectExpr("right_id AS needle_id", "right AS needle"), left.selectExpr("left_id AS text_id", "left AS text"), gram)
    return there.selectExpr("needle_id AS left_id", "text_id AS right_id").unionByName(back.selectExpr("text_id AS left_id", "needle_id AS right_id")).distinct()
