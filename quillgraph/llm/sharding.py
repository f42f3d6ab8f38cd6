"""Sharding by balanced label propagation: linked documents meet in a shard, sizes stay even.

Documents are linked when they agree in one of the given expressions (here: in
their text). A link is a key, so a group of n documents is n rows, never its
pairs. Linked documents start in shards drawn by hash. In each round two joins
count, for every document, its neighbours in each shard; it then wishes to
move to the shard that has most of them, among its own and those with room.
Equal counts are ordered by a hash of the key, so that all of a group agree.
Wishes are summed by target, gain and a hash bin; in falling order of gain the
bins that fit under a target's quota, an equal share of all bytes and a little
slack, are granted; what leaves a shard makes room for others. Rounds end when
none is granted.

Rows without links are the ballast: they, and what a shard holds above its
quota, are summed in bins by size and hash, and the bins go to the emptiest
shard, the largest bin first, until sizes are level. All sums that the driver
sees are bounded by ``BINS`` and the number of shards, whatever the table.

No step gathers a group: keys are counted by (key, shard) before the shuffle,
a group larger than a quota fills several shards, and slots are numbered along
one range sort.

Defined results: a null text counts as empty. Keys are 64-bit hashes; texts
that share one are kept together as if they were equal. Rows that share doc_id
and text (ties) are placed one by one; which of them gets which shard follows
the place of the rows in the files, as it does for null doc_ids. Very long
texts are read whole, their size decides. Columns named like an output are
replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import written
from quillgraph.llm.ordering import numbered

SHARDS, ROUNDS = 16, 12
#: What a shard may hold above its quota while rows move, and what it holds when no row wishes to go there any more.
SLACK, FULL = 0.05, 0.02
#: Hash bins of wishes of equal gain, and of rows of a size class (sizes are at most 2 ** 31: 32 classes).
WISHES, BINS = 64, 1024
#: Neighbours in its shard below which a row leaves it together with them.
FEW = 16


def _bin(name: str, n: int, by: str | Column = "_u") -> Column:
    return F.pmod(F.xxhash64(by, F.lit(name)), F.lit(n)).cast("int")


def nodes(docs: DataFrame, links: list[Column]) -> DataFrame:
    """(_row, doc_id, size, text_crc32, keys, _u) of each row; _u is the hash that decides for it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = F.array_distinct(F.array_compact(F.array(*(F.when(x.isNotNull(), F.xxhash64(x, F.lit(i))) for i, x in enumerate(links)))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_text"), keys.alias("keys"))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "shard-nodes")
    own = F.xxhash64("doc_id", "_text")
    alone = rows.groupBy(own.alias("_u")).count().filter("count > 1").isEmpty()
    return rows.withColumn("_u", F.when(F.col("doc_id").isNull(), F.xxhash64("_row")).otherwise(own) if alone else F.xxhash64("_row"))


def _grant(moves: list, load: list[int], quota: int) -> set[tuple[int, int, int]]:
    """(target, gain class, bin) of the wishes that are granted, the largest gains first; load is brought up to date.

    What leaves a shard makes room there, so the wishes are gone through again until none fits any more.
    """
    wishes: dict[tuple[int, int, int], dict[int, int]] = {}
    for r in moves:
        wishes.setdefault((r["target"], r["class"], r["bin"]), {})[r["shard"]] = r["bytes"]
    waiting, out = sorted(wishes, key=lambda at: (-at[1], at[0], at[2])), set()
    while True:
        left = []
        for at in waiting:
            size = sum(wishes[at].values())
            if load[at[0]] + size > quota:
                left.append(at)
                continue
            out.add(at)
            load[at[0]] += size
            for source, n in wishes[at].items():
                load[source] -= n
        if len(left) == len(waiting):
            return out
        waiting = left


def propagate(rows: DataFrame, n_shards: int, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """(_row, _u, _hold, size, shard) of the linked rows after label propagation; rows that agree in _hold leave a shard together."""
    spark = rows.sparkSession
    members = rows.select("_row", "_u", "size", F.explode("keys").alias("key"))
    # written before the join, so that Spark can split the join of a key that very many rows share
    shared = written(members.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key"), "shard-keys")
    members = written(members.join(shared, "key"), "shard-members")
    labels = members.select("_row", "_u", "size").distinct()
    labels = labels.withColumns({"shard": _bin("start", n_shards), "_hold": F.col("_u")})
    load, bound = [0] * n_shards, int(quota * (1 + SLACK))
    for r in labels.groupBy("shard").agg(F.sum("size").alias("n")).collect():
        load[r["shard"]] = r["n"]
    for turn in range(rounds):
        here = members.select("_row", "key").join(labels.drop("_hold"), "_row")
        counts = here.groupBy("key", "shard").agg(F.count("*").alias("_n")).withColumnRenamed("shard", "_to")
        votes = here.join(counts, "key").groupBy("_row", "_u", "size", "shard", "_to").agg(F.sum("_n").alias("_n"), F.min("key").alias("_key"), F.count("*").alias("_own"))
        at_home, open_ = F.col("_to") == F.col("shard"), F.col("_to").isin([j for j, n in enumerate(load) if n < quota * (1 + FULL)])
        # of its own shard a row counts its neighbours, not itself; while the shard is open all of a group count alike and so agree
        others = F.when(at_home, F.col("_n") - F.col("_own")).otherwise(F.col("_n"))
        best = votes.filter(open_ | at_home).withColumns({"_n": F.when(open_, F.col("_n")).otherwise(others), "_others": others, "_tie": F.xxhash64("_key", "_to")})
        own = F.sum(F.when(at_home, F.col("_others")).otherwise(0))
        best = best.groupBy("_row", "_u", "size", "shard").agg(F.max(F.struct("_n", "_tie", "_to")).alias("_best"), own.alias("_stay"), F.min("_key").alias("_key"))
        gain = F.col("_best._n") - F.col("_stay")
        # few neighbours stay with a row when it has to leave later, many are too much for one bin
        hold = F.when(F.col("_stay") < FEW, F.col("_key")).otherwise(F.col("_u"))
        best = best.select("_row", "_u", hold.alias("_hold"), "size", "shard", F.col("_best._to").alias("target"), F.floor(F.log2(F.greatest(gain, F.lit(1)))).cast("int").alias("class"), _bin(f"wish{turn}", WISHES).alias("bin"))
        best = written(best, "shard-wishes")
        moves = best.filter("target <> shard").groupBy("target", "class", "bin", "shard").agg(F.sum("size").alias("bytes")).collect()
        granted = _grant(moves, load, bound)
        labels = best.select("_row", "_u", "_hold", "size", "shard")
        if not granted:
            break
        allowed = F.broadcast(spark.createDataFrame(sorted(granted), "target int, class int, bin int").withColumn("_goes", F.lit(True)))
        moved = best.join(allowed, ["target", "class", "bin"], "left")
        labels = moved.select("_row", "_u", "_hold", "size", F.when(F.col("_goes"), F.col("target")).otherwise(F.col("shard")).alias("shard"))
    return labels


def _level(load: list[int], bins: list) -> list[tuple[int, int, int]]:
    """(size class, bin, shard): the largest bin first, each to the emptiest shard."""
    heap = [(n, j) for j, n in enumerate(load)]
    heapq.heapify(heap)
    out = []
    for r in sorted(bins, key=lambda r: (-r["bytes"], r["class"], r["bin"])):
        n, j = heapq.heappop(heap)
        out.append((r["class"], r["bin"], j))
        heapq.heappush(heap, (n + r["bytes"], j))
    return out


def place(docs: DataFrame, links: list[Column] | None = None, n_shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(_row, doc_id, size, text_crc32, shard, slot) of each row of docs, linked by equal values of links (null: none)."""
    spark = docs.sparkSession
    rows = nodes(docs, [F.coalesce(F.col("text").cast("string"), F.lit(""))] if links is None else links)
    quota = (rows.agg(F.sum("size").alias("n")).first()["n"] or 0) // n_shards
    kept = propagate(rows, n_shards, quota, rounds).select("_row", "_hold", "shard")
    size_class = F.floor(F.log2("size")).cast("int")
    rows = rows.join(kept, "_row", "left").select("_row", "doc_id", "size", "text_crc32", "shard", size_class.alias("class"), _bin("ballast", BINS, F.coalesce("_hold", "_u")).alias("bin"))
    rows = written(rows, "shard-labels")
    parts = rows.filter("shard IS NOT NULL").groupBy("shard", "class", "bin").agg(F.sum("size").alias("bytes"))
    load = [0] * n_shards
    for r in parts.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():
        load[r["shard"]] = r["bytes"]
    over = [j for j, n in enumerate(load) if n > quota]
    freed = []
    for r in sorted(parts.filter(F.col("shard").isin(over)).collect(), key=lambda r: (r["shard"], r["bin"], r["class"])) if over else []:
        if load[r["shard"]] > quota:  # what a shard holds above its quota goes back to the ballast
            load[r["shard"]] -= r["bytes"]
            freed.append((r["shard"], r["class"], r["bin"]))
    out = spark.createDataFrame(freed, "shard int, class int, bin int").withColumn("_free", F.lit(True))
    rows = rows.join(F.broadcast(out), ["shard", "class", "bin"], "left").withColumn("shard", F.when(F.col("_free"), None).otherwise(F.col("shard"))).drop("_free")
    bins = rows.filter("shard IS NULL").groupBy("class", "bin").agg(F.sum("size").alias("bytes")).collect()  # 32 * BINS sums at most
    level = spark.createDataFrame(_level(load, bins), "class int, bin int, _level int")
    rows = rows.join(F.broadcast(level), ["class", "bin"], "left").withColumn("shard", F.coalesce("shard", "_level"))
    rows = rows.select("_row", "doc_id", "size", "text_crc32", "shard")
    return numbered(rows, [F.col("doc_id").asc_nulls_last(), "text_crc32", "size", "_row"], "slot", "shard-slots", by="shard")


def sharded(docs: DataFrame, links: list[Column] | None = None, n_shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """docs with ``shard`` and ``slot``, ready to be written by ``partitionBy("shard")``."""
    whole = written(docs.withColumn("_line", F.monotonically_increasing_id()), "shard-rows")
    named = whole.withColumns({"doc_id": F.col("_line")})  # places are told apart by the line, whatever doc_id repeats
    found = place(named, links, n_shards, rounds).select(F.col("doc_id").alias("_line"), "shard", "slot")
    return whole.drop("shard", "slot").join(found, "_line").drop("_line")


def cut_links(placed: DataFrame, key: str = "text_crc32") -> tuple[int, int]:
    """(links between shards, all links) of rows that share key, counted without making pairs."""
    n = F.col("n")
    by = placed.groupBy(key, "shard").agg(F.count("*").alias("n")).groupBy(key).agg(F.sum(n * (n - 1)).alias("kept"), F.sum(n).alias("n"))
    found = by.agg(F.sum(n * (n - 1)).alias("all"), F.sum("kept").alias("kept")).first()
    return ((found["all"] or 0) - (found["kept"] or 0)) // 2, (found["all"] or 0) // 2


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of all ``documents``, equal in bytes; equal texts are linked."""
    placed = place(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
