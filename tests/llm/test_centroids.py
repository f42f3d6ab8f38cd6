import hashlib
import math
import random

import duckdb
import numpy as np

from quillgraph.llm import centroids as C


def brute(rows, k=C.K, rounds=C.ROUNDS, width=C.WIDTH):
    kept = [(i, [math.floor(x * 1024) if abs(x) < 1e300 else int(x) * 1024 for x in e]) for i, e in rows if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest())
    now = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        now = [[sum(col) // of.count(j) for col in zip(*(v for (_, v), o in zip(kept, of, strict=True) if o == j), strict=True)] if j in of else c for j, c in enumerate(now)]
    last = [near(v) for _, v in kept]
    per = {j: sum(d for d, o in last if o == j) for j in range(len(now))}
    long = lambda v: v if v < 1 << 63 else None
    found = ((i, j, long(d), long(per[j]), long(sum(per.values())), hashlib.sha256(",".join(map(str, now[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True))
    return sorted(found, key=str)


def result(spark, rows, schema="vec_id long, embedding array<double>, cluster string"):
    df = spark.createDataFrame([(*r, "clash") for r in rows], schema).repartition(5)
    return sorted((tuple(r) for r in C.report(*C.cluster(df)).collect()), key=str)


def test_against_brute_force(spark):
    draw = random.Random(4)
    rows = [(i, [round(draw.gauss(draw.choice([-1, 0, 2]), 0.4), 3) for _ in range(64)]) for i in range(150)]
    # ties between centroids: vectors on a coarse grid, and copies of one vector
    rows += [(1000 + i, [float(draw.randint(-1, 1)) / 1024 for _ in range(64)]) for i in range(60)] + [(2000 + i, [0.0] * 64) for i in range(70)]
    odd = [(3000, None), (3001, [0.0] * 63), (3002, [None] + [0.0] * 63), (3003, [math.nan] * 64), (3004, [math.inf] + [0.0] * 63), (3005, []), (7, [0.5] * 64), (7, [0.5] * 64)]
    assert result(spark, rows + odd) == brute(rows + odd)


def test_wide_components(spark):
    rows = [(i, [float((i * 7 + j) % 5) * s for j in range(64)]) for i, s in enumerate([1.0, 3e5, 2e6, 1e3] * 8)]
    assert result(spark, rows) == brute(rows)


def test_distances_past_a_long(spark):
    rows = [(1, [1e306] * 64), (2, [0.25] * 64)] + [(i, [i / 9.0] * 64) for i in range(3, 12)] + [(i, [-3.4e38 * i] + [0.0] * 63) for i in range(20, 40)]
    got = result(spark, rows)
    assert got == brute(rows) and None in [r[2] for r in got] and {r[4] for r in got} == {None}


def test_intervals_hold_the_true_value():
    draw = np.random.default_rng(1)
    for scale in (3, 900, 2**20, 2**30):
        x = draw.integers(-scale, scale, (300, 64))
        c = x[draw.integers(0, 300, 40)] + draw.integers(-1, 2, (40, 64))
        m = C.Centroids(c.tolist())
        true = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x], dtype=object)
        left = m.candidates(x)
        best = np.array([min(range(40), key=lambda j: (row[j], j)) for row in true])
        assert left[np.arange(300), best].all()
        assert (m.nearest(x) == best).all()
        if scale == 900:
            assert left.sum() < 40 * 300 / 4


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(None, [0.1] * 64), (2, [0.1] * 64), (3, [0.9] * 64)]
    got = C.report(*C.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))
    assert result(spark, [(1, [1.0])]) == [] and C.report(*C.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"))).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = sorted(con.sql(C.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in C.op11_centroids(spark, d).collect()) == want and len(want) > 100
