"""Centroid clustering in whole numbers, screened by float32 products.

Vectors become integers, floor(scale * x). A round assigns every vector to its
nearest centroid and replaces each centroid by the floor of its members' mean.
The nearest centroid is exact, yet nearly all of the arithmetic is one float32
matrix product: |x - c|^2 differs between centroids by |c|^2 - 2 x.c only, and
a float32 product of ``width`` terms is off by at most gamma * |x| * |c| with
gamma = k u / (1 - k u), u = 2^-24 and k = width + 2 (the sum in any order, and
both factors rounded), so each centroid gets an interval that holds its true
value. Centroids whose interval lies above the end of another one are out.
Where more than one is left, their distances are computed in integers and the
smallest one wins, the lowest number among equals.

A round is one pass over the packed vectors. A task sends one sum a centroid
and component, cut into limbs of 40 bits so that Spark's own sums are exact at
any size; the driver sees ``k * width`` totals only, never a vector but the
first k. No rows are shuffled, so a vector that a third of the rows repeat
costs what others cost.

Defined results: rows whose vector is null, has another length or a component
that is null or not finite are left out. Rows that share a vec_id are assigned
one by one; a null vec_id counts as the empty text when the first centroids are
drawn, and rows with equal hashes (ties) follow the order of their components.
With fewer than k vectors there are as many centroids; an empty table gives an
empty table. A squared distance beyond 2^63 - 1 is null, and so are the sums it
is part of; it is compared exactly all the same. There is no text to be long.
Other columns are ignored, those named like an output included.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import written

#: Components of a vector, centroids, rounds, the number before the id in the hash that draws the first centroids, scale.
WIDTH, K, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Bits of a limb of a sum.
LIMB = 40
#: Cells of the matrix of vectors and centroids that a task holds at a time.
CELLS = 1 << 21

_LONGEST = (1 << 63) - 1


def packed_vectors(vectors: DataFrame, vec: str = "embedding", vec_id: str = "vec_id", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, comps, wide) of the vectors that count: int32 components as bytes, or decimal text where one doesn't fit."""
    x = F.col(vec).cast("array<double>")
    whole = vectors.select(F.col(vec_id).alias("vec_id"), x.alias("x")).filter((F.size("x") == width) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))

    def pack(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            with np.errstate(over="ignore"):
                scaled = np.floor(x * scale)
            wide = ~(np.abs(scaled) < 2**31).all(axis=1)
            raw = np.ascontiguousarray(np.where(wide[:, None], 0, scaled).astype("<i4"))
            comps = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * width), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
            if wide.any():  # scale * x may be past the doubles, x itself is then an integer
                listed = comps.to_pylist()
                for i in np.flatnonzero(wide):
                    listed[i] = ",".join(str(int(s) if np.isfinite(s) else int(v) * scale) for s, v in zip(scaled[i], x[i], strict=True)).encode()
                comps = pa.array(listed, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), comps, pa.array(wide)], ["vec_id", "comps", "wide"])

    return whole.mapInArrow(pack, f"vec_id {whole.schema['vec_id'].dataType.simpleString()}, comps binary, wide boolean")


def unpacked(comps: list[bytes], wide: np.ndarray, width: int):
    """(places, integers) of the narrow vectors, then of the wide ones as Python integers."""
    for which in (False, True):
        at = np.flatnonzero(wide == which)
        if not len(at):
            continue
        if which:
            yield at, np.array([[int(v) for v in comps[i].split(b",")] for i in at], dtype=object)
        else:
            yield at, np.frombuffer(b"".join([comps[i] for i in at]), "<i4").reshape(-1, width).astype(np.int64)


def exact_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x and c, in 64 bits where they fit, else in Python's integers."""
    if x.dtype != object and c.dtype != object:
        far = np.abs(x - c)
        if not far.size or int(far.max()) ** 2 * x.shape[1] <= _LONGEST:
            return (far * far).sum(axis=1)
    far = x.astype(object) - c.astype(object)
    return (far * far).sum(axis=1)


class Centroids:
    """Integer centroids with what the screening needs of them."""

    def __init__(self, rows: list[list[int]]):
        small = all(abs(v) < 2**31 for row in rows for v in row)
        self.exact = np.array(rows, dtype=np.int64 if small else object)
        with np.errstate(over="ignore"):
            self.single = np.array([[_float(v) for v in row] for row in rows], dtype=np.float64).astype(np.float32)
        self.squares = np.array([_float(sum(v * v for v in row)) for row in rows], dtype=np.float64)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """For each row of x, which centroids can be the nearest."""
        k = self.single.shape[1] + 2
        gamma = k * 2.0**-24 / (1 - k * 2.0**-24)
        with np.errstate(all="ignore"):
            wide = x.astype(np.float64) if x.dtype != object else np.array([[_float(v) for v in row] for row in x], dtype=np.float64)
            dots = (wide.astype(np.float32) @ self.single.T).astype(np.float64)
            lengths = np.sqrt((wide * wide).sum(axis=1))[:, None] * np.sqrt(self.squares)[None, :]
            value = self.squares - 2 * dots
            # the second term covers the rounding of these few float64 steps themselves
            slack = (2 * gamma * lengths + 2.0**-46 * (self.squares + 2 * np.abs(dots) + lengths)) * (1 + 2.0**-40)
            low, high = value - slack, value + slack
            out = low <= high.min(axis=1, keepdims=True)
        out[~(np.isfinite(low) & np.isfinite(high)).all(axis=1)] = True
        return out

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The number of each row's nearest centroid, the lowest among equals."""
        out = np.empty(len(x), np.int64)
        step = max(1, CELLS // len(self.exact))
        for i in range(0, len(x), step):
            part = x[i : i + step]
            left = self.candidates(part)
            found = left.argmax(axis=1)
            open_ = np.flatnonzero(left.sum(axis=1) > 1)
            if len(open_):
                row, number = np.nonzero(left[open_])
                far = exact_distances(part[open_[row]], self.exact[number])
                order = np.lexsort((number, far, row)) if far.dtype != object else np.array(sorted(range(len(far)), key=lambda t: (row[t], far[t], number[t])))
                first = order[np.concatenate(([True], np.diff(row[order]) > 0))]
                found[open_] = number[first]
            out[i : i + step] = found
        return out


def _float(v: int) -> float:
    try:
        return float(v)
    except OverflowError:
        return float("inf")


def _limbs(total: int):
    """(limb, value): total is the sum of value << LIMB * limb."""
    sign, rest, i = (-1 if total < 0 else 1), abs(total), 0
    while rest or not i:
        yield i, sign * (rest & ((1 << LIMB) - 1))
        rest >>= LIMB
        i += 1


def _sums(now: Centroids, width: int):
    """A task's totals: (cluster, pos, limb, value), the count at pos = -1."""

    def run(batches):
        totals = np.zeros((len(now.exact), width), dtype=object)
        counts = np.zeros(len(now.exact), np.int64)
        for frame in batches:
            for _, x in unpacked(frame["comps"].tolist(), frame["wide"].to_numpy(bool), width):
                number = now.nearest(x)
                order = np.argsort(number, kind="stable")
                met, first, n = np.unique(number[order], return_index=True, return_counts=True)
                totals[met] += np.add.reduceat(x[order], first, axis=0).astype(object)
                counts[met] += n
        rows = [(j, pos, limb, value) for j in np.flatnonzero(counts) for pos, total in ((-1, int(counts[j])), *enumerate(totals[j])) for limb, value in _limbs(int(total))]
        yield pd.DataFrame(rows, columns=["cluster", "pos", "limb", "value"])

    return run


def _assign(now: Centroids, width: int):
    def run(batches):
        for frame in batches:
            number, distance = np.zeros(len(frame), np.int32), np.zeros(len(frame), dtype=object)
            for at, x in unpacked(frame["comps"].tolist(), frame["wide"].to_numpy(bool), width):
                number[at] = now.nearest(x)
                distance[at] = exact_distances(x, now.exact[number[at]]).astype(object)
            fits = pd.array([d if d <= _LONGEST else None for d in distance], dtype="Int64")
            yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": number, "distance": fits})

    return run


def first_centroids(packed: DataFrame, k: int, seed: int, width: int) -> list[list[int]]:
    """The k vectors with the smallest hash of seed and vec_id."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = packed.select(mark.alias("_mark"), "wide", "comps").orderBy("_mark", "wide", "comps").limit(k).collect()
    return [[int(v) for v in next(unpacked([bytes(r["comps"])], np.array([r["wide"]]), width))[1][0]] for r in rows]


def cluster(vectors: DataFrame, vec: str = "embedding", vec_id: str = "vec_id", k: int = K, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of each vector, the final centroids)."""
    packed = written(packed_vectors(vectors, vec, vec_id, width, scale), "vectors")
    now = first_centroids(packed, k, seed, width)
    for _ in range(rounds if now else 0):
        parts = packed.select("comps", "wide").mapInPandas(_sums(Centroids(now), width), "cluster int, pos int, limb int, value long")
        total: dict[tuple[int, int], int] = {}
        for r in parts.groupBy("cluster", "pos", "limb").agg(F.sum("value").alias("value")).collect():  # k * (width + 1) totals of a few limbs
            total[r["cluster"], r["pos"]] = total.get((r["cluster"], r["pos"]), 0) + (r["value"] << LIMB * r["limb"])
        then = [[total[j, p] // total[j, -1] for p in range(width)] if (j, -1) in total else row for j, row in enumerate(now)]
        if then == now:  # all rounds to come would repeat this one
            break
        now = then
    schema = f"vec_id {packed.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    if not now:
        return vectors.sparkSession.createDataFrame([], schema), now
    return written(packed.mapInPandas(_assign(Centroids(now), width), schema), "clusters"), now


def _total(rows: list, name: str) -> int | None:
    """The sum of a column of rows, or null where a member has none or the sum is no long."""
    if any(r["members"] != r["measured"] for r in rows):
        return None
    found = sum(int(r[name] or 0) for r in rows)
    return found if found <= _LONGEST else None


def report(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Each assigned vector with the inertias and the hash of its final centroid."""
    by = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"), F.count("*").alias("members"), F.count("distance").alias("measured")).collect()
    whole = _total(by, "inertia")
    rows = [(r["cluster"], _total([r], "inertia"), whole, hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in by]
    about = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of all ``embeddings``."""
    return report(*cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _oracle() -> str:
    """Rounds are chained tables: distances by components, the nearest centroid, floors of means."""
    steps = [
        f"kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH})",
        f"v AS MATERIALIZED (SELECT vec_id, unnest(range({WIDTH})) AS pos, CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS val FROM kept)",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM kept)",
        f"c0 AS MATERIALIZED (SELECT c, pos, val FROM f JOIN v USING (vec_id) WHERE c < {K})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"d{i} AS (SELECT v.vec_id, c, sum((v.val - m.val) * (v.val - m.val)) AS d FROM v JOIN c{i} AS m USING (pos) GROUP BY ALL)")
        steps.append(f"a{i} AS MATERIALIZED (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if i < ROUNDS:
            mean = f"SELECT c, pos, CAST(floor(CAST(sum(val) AS DOUBLE) / count(*)) AS BIGINT) AS val FROM v JOIN a{i} USING (vec_id) GROUP BY ALL"
            steps.append(f"c{i + 1} AS MATERIALIZED ({mean} UNION ALL SELECT * FROM c{i} WHERE c NOT IN (SELECT c FROM a{i}))")
    steps.append(f"h AS (SELECT c, sha256(string_agg(CAST(val AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)")
    last = f"SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN h USING (c)"
    return f"WITH {', '.join(steps)} {last}"


ORACLE_SQL = _oracle()
