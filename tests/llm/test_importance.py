import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from quillgraph.llm import importance as I
from quillgraph.llm import ordering as O

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def features(text, longest):
    words = WORD.findall(lowered(text))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest=1, buckets=I.BUCKETS, least=I.LEAST_WORDS, percent=I.PERCENT):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(f % buckets for f in features(text, longest)[1])
    for text in target:
        t.update(f % buckets for f in features(text, longest)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        words, found = features(text, longest)
        weight = sum(gain(f % buckets) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)])
    may = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(may[: percent * len(may) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def texts(seed, n):
    draw = random.Random(seed)
    vocabulary = ["Word", "a1", "été", "Ünder", "中文", "x" * 70, "the", "OF", "42", "ß", *(f"w{i}" for i in range(200))]
    return [draw.choice([" ", ", ", "\n", "--"]).join(draw.choice(vocabulary) for _ in range(draw.choice([0, 3, 19, 20, 21, 60, 300]))) for _ in range(n)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(O, "DIGIT", 7)
    docs = list(enumerate(texts(1, 300), 5)) + [(1, None), (2, ""), (3, "\x00\x7f ,"), (None, "w1 w2 " * 30), (None, "w1 w2 " * 30), (None, None), (77, "again " * 25), (77, "again " * 25), (77, "w3 " * 25), (-9, "long " * 200_000), (4, "y" * 300_000)]
    target = texts(2, 9) + [None]
    frame = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, weight int").repartition(6)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert sorted((tuple(r) for r in I.resample(frame, goal).collect()), key=str) == brute(docs, target)
    got = I.resample(frame, goal, longest=3, buckets=70_000, least_words=3, percent=60).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, target, 3, 70_000, 3, 60)


def test_a_third_of_equal_rows(spark):
    docs = [(5, "same text here " * 10)] * 120 + list(enumerate(texts(3, 200), 100))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    goal = spark.createDataFrame([("same text",)], "text string")
    assert sorted((tuple(r) for r in I.resample(frame, goal).collect()), key=str) == brute(docs, ["same text"])


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert I.resample(none, none).collect() == []
    few = spark.createDataFrame([(1, "too short")], "doc_id long, text string")
    assert [tuple(r) for r in I.resample(few, none).collect()] == brute([(1, "too short")], [])


def test_checksums():
    raw = np.frombuffer(bytes(range(256)) * 5, np.uint8)
    draw = np.random.default_rng(0)
    starts = draw.integers(0, 1200, 500)
    ends = starts + np.minimum(draw.integers(0, 200, 500), len(raw) - starts)
    assert I.crc32_spans(raw, starts, ends).tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


def test_kth_key(spark, monkeypatch):
    monkeypatch.setattr(O, "DIGIT", 10)
    draw = random.Random(5)
    rows = [(draw.choice([-(2**63), 2**63 - 1, -1, 0, 1, 7, draw.randint(-(10**9), 10**9)]), draw.randint(0, 3), i) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    for k in (1, 200, 399):
        got = df.filter(O.within(O.kth(df, ["a", "b", "c"], k))).collect()
        assert sorted(map(tuple, got)) == sorted(rows)[:k]
    line = O.numbered(df, ["a", "c"], "at", "line", by="b").collect()
    for b in range(4):
        own = sorted((r["at"], r["a"], r["c"]) for r in line if r["b"] == b)
        assert [(a, c) for _, a, c in own] == sorted((a, c) for a, x, c in rows if x == b) and [i for i, *_ in own] == list(range(len(own)))


def test_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = sorted(con.sql(I.ORACLE_SQL).fetchall(), key=str)
    assert sorted((tuple(r) for r in I.op12_importance(spark, d).collect()), key=str) == want and any(r[4] for r in want)
