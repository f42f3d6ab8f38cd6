import hashlib
import random

import numpy as np

from quillgraph.llm import order_minhash as O


def brute(text):
    """Sketches from the definition: numbered k-mers, the two minimal hashes of each bin, in text order."""
    points = [ord(c) + 1 for c in text]
    if not points:
        return [None] * O.BINS
    points += [0] * (O.K - len(points))
    seen, bins = {}, {}
    count = len(points) - O.K + 1
    for i in range(count):
        gram = text[i : i + O.K]
        nth = seen[gram] = seen.get(gram, 0) + 1
        number = sum(p * int(w) for p, w in zip(points[i : i + O.K], O._POWERS, strict=True)) % 2**64
        number = int(O.mix(np.array([number], np.uint64))[0]) + nth * 0x9E3779B97F4A7C15
        h = int(O.mix(np.array([number % 2**64], np.uint64))[0])
        bins.setdefault(h >> 58, []).append((h, i))
    return [tuple(h for h, _ in sorted(sorted(bins[b])[: O.L], key=lambda x: x[1])) if b in bins else None for b in range(O.BINS)]


def test_against_definition():
    r = random.Random(1)
    texts = ["", "ab", "ababababababababab", "é東🙂" * 40] + ["".join(r.choice("abcd ") for _ in range(r.choice([9, 50, 400, 3000]))) for _ in range(12)]
    prints, slow = [O.fingerprint(t) for t in texts], [brute(t) for t in texts]
    for a, x in zip(prints, slow, strict=True):
        assert [v == 0 for v in a] == [v is None for v in x]
        for b, y in zip(prints, slow, strict=True):
            same = [u == v for u, v in zip(x, y, strict=True)]
            assert sum((a == b).tolist()) - sum(same) in (0, 1)


def test_follows_edits():
    r = random.Random(2)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))
    words = [word() for _ in range(600)]
    like = []
    for changed in (0, 10, 60, 300):
        other = list(words)
        for i in r.sample(range(600), changed):
            other[i] = word()
        like.append(O.likeness(O.fingerprint(" ".join(words)), O.fingerprint(" ".join(other))))
    assert like[0] == 1 and like == sorted(like, reverse=True) and like[1] > 0.7 and like[3] < 0.4
    moved = words[300:] + words[:300]
    assert O.likeness(O.fingerprint(" ".join(words)), O.fingerprint(" ".join(moved))) < 0.8


def test_likeness_across_lengths():
    """A text and the same with two characters or two in a hundred more are alike at every length around the powers of two."""
    r = random.Random(4)
    long = "".join(r.choice("etaoin shrdlu") for _ in range(70_000))
    for power in range(6, 17):
        for n in (2**power - 2, 2**power - 1, 2**power, 2**power + 1, 2**power + 7, 2**power + 8):
            for more in (2, max(2, n // 50)):
                assert O.likeness(O.fingerprint(long[:n]), O.fingerprint(long[: n + more])) > 0.8, (n, more)


def test_place(spark):
    r = random.Random(5)
    for size in (0, 1, 2, 3, 10, 57):
        cuts = sorted(r.sample(range(-200, 200), size)) + ([2**63 - 1] if size > 3 else [])
        rows = spark.range(-210, 210).select("id", O._place(cuts, "id").alias("b")).collect()
        assert all(x.b == sum(c < x.id for c in cuts) for x in rows)


def test_rows(spark):
    rows = [(5, "hello there world"), (1, "abc"), (9, None), (7, ""), (None, "no id"), (5, "hello there world"), (12, "x y z " * 4000), (13, "naïve 🙂 text with points")]
    got = O.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").withColumn("copy", O.F.lit("clash"))).collect()
    line = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = {}
    for (i, t), (_, after) in zip(line, line[1:] + line[:1], strict=True):
        t, after = t or "", after or ""
        e = O.edited(t, after)
        a, b, c = map(O.fingerprint, (t, e, after))
        want.setdefault(i, []).append((len(t), hashlib.sha256(e.encode()).hexdigest(), O.likeness(a, b), O.likeness(a, c)))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256, r.near_edited, r.near_next))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_empty(spark):
    assert O.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    got = {r.doc_id: r for r in O.op3_order_minhash(spark, d).collect()}
    assert len(got) == len(docs)
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        assert got[i].edited_sha256 == hashlib.sha256(O.edited(t, after).encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1
