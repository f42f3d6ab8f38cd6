import random

import numpy as np

from quillgraph.llm import suffix_dedup as S


def brute(rows):
    """From the definition: the smallest doc_id of each 50-byte string, then the bytes that a smaller one covers."""
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        i = S._NO_ID if i is None else i
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        own = S._NO_ID if i is None else i
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < own:
                gone[k : k + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def test_borders_from_transform():
    r = np.random.default_rng(1)
    for n, sigma in [(1, 2), (2, 1), (40, 1), (300, 2), (2000, 3), (3000, 30)]:
        text = r.integers(1, sigma + 1, n).astype(np.int16)
        text[-1] = 0
        for depth in (1, 2, 5, 50):
            order = S.suffix_order(text, depth)
            cut = [tuple(text[i : i + depth]) for i in order]
            assert cut == sorted(cut)
            want = [True] + [a != b for a, b in zip(cut, cut[1:])]
            assert S.borders(text[order - 1].astype(np.uint16), depth).tolist() == want


def test_order_by_position():
    text = np.random.default_rng(2).integers(0, 3, 5000).astype(np.int16)
    assert S.suffix_order(text, 50).tolist() == sorted(range(5000), key=lambda i: (tuple(text[i : i + 50]), i))


def make(r, n):
    passage = [" ".join(f"w{r.randrange(50)}" for _ in range(r.choice([5, 14, 30, 80]))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(0, 6)):
            parts.append(r.choice(passage) if r.random() < 0.5 else "".join(r.choice("abcdefgh é") for _ in range(r.randrange(0, 200))))
        rows.append((i, " ".join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "x" * 300), (n + 3, "x" * 120), (n + 4, "ab" * 100), (None, rows[3][1]), (None, passage[3] * 3), (7, rows[5][1] + passage[3]), (7, passage[3])]
    rows += [(n + 10 + k, rows[4][1]) for k in range(5)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3000)
    rows = make(random.Random(4), 120)
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, kept string")
    got = S.dedup(docs).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=key) == sorted(brute(rows), key=key)


def test_empty(spark):
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids_and_long_texts(spark, monkeypatch):
    """Rows without a doc_id are spread over blocks and lose what a doc_id has; a very long text is cut like others."""
    monkeypatch.setattr(S, "BLOCK", 4000)
    passage = "".join(chr(97 + (i * i) % 26) for i in range(120))
    long = " ".join(f"{i * 7919 % 100_003}" for i in range(60_000))
    rows = [(1, passage), (2, long), (3, long + passage)] + [(None, f"row {i} starts " + passage + f" and ends {i}") for i in range(300)]
    got = S.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed").collect()
    assert len(got) == 303
    by = {r.doc_id: r.n_removed for r in got if r.doc_id}
    assert by[1] == by[2] == 0 and by[3] == len(long) + len(passage)
    assert all(r.n_removed == len(passage) for r in got if r.doc_id is None)
