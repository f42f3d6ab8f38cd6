import random

import numpy as np
import pytest

from quillgraph.llm import jaccard_join as J


def grams(text):
    w = (text or "").encode().translate(J._ASCII_LOWER).split()
    return set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, grams(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, r) in enumerate(sets):
        for j, s in sets[:k]:
            both = len(r & s)
            if both and 100 * both >= 80 * (len(r) + len(s) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i, _ in sets}


def edits(r, words, rate):
    out = []
    for w in words:
        x = r.random()
        if x < rate:
            out.append(f"new{r.randrange(10**6)}")
        elif x >= rate * 1.3:
            out.append(w)
    return out


@pytest.mark.parametrize("group", [256, 30])
def test_against_brute_force(spark, monkeypatch, group):
    """Also where most groups are too large to be compared among themselves."""
    monkeypatch.setattr(J, "GROUP", group)
    monkeypatch.setattr(J, "SPREAD", 16)
    r = random.Random(5)
    rows = [(0, None), (1, ""), (2, "  \t "), (3, "One two"), (4, "one TWO"), (5, "one two three"), (6, "a b c d e"), (7, "A b c d e"), (8, "é É e"), (None, "a b c d e")]
    passage = [f"p{i}" for i in range(60)]
    while len(rows) < 300:
        n = int(r.choice([5, 6, 8, 10, 13, 18, 25, 40, 60, 120, 300, 900]) * r.uniform(0.9, 1.1))
        base = [f"w{r.randrange(400)}" for _ in range(n)]
        if r.random() < 0.3:
            base += passage
        for _ in range(r.randrange(1, 6)):
            rows.append((len(rows), " ".join(edits(r, base, r.choice([0, 0.01, 0.02, 0.03, 0.04, 0.08])))))
    hot = [f"h{i}" for i in range(200)]
    for _ in range(60):
        rows.append((len(rows), " ".join(edits(r, hot, 0.02))))
    rows += [(len(rows) + k, "long " + " ".join(f"l{(i * 7919) % 5003}" for i in range(40_000))) for k in range(2)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).withColumn("n_shingles", J.F.lit("clash"))
    got = J.joined(docs).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {x.doc_id: x.component_id for x in got if x.doc_id is not None} == want
    sizes = {i: len(grams(t)) for i, t in rows}
    assert all(x.n_shingles == sizes[x.doc_id] for x in got)


def test_pigeonhole():
    """Similar sets of every size share a signature that the larger one probes."""
    r = np.random.default_rng(3)
    for n in [5, 6, 7, 9, 11, 14, 20, 31, 44, 46, 60, 100, 333, 1000, 5000]:
        for _ in range(8):
            big = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            drop = int(r.integers(0, n))
            for removed in range(drop + 1):
                small = big[removed:]
                added = r.integers(0, 2**63, int(r.integers(0, 3))).astype(np.uint64) if removed else np.zeros(0, np.uint64)
                small = np.unique(np.concatenate((small, added)))
                if len(small) > len(big):
                    continue
                both = len(np.intersect1d(big, small))
                if 100 * both < 80 * (len(big) + len(small) - both):
                    break
                v, p = J.signatures(big)
                u, _ = J.signatures(small)
                if not (len(big) == len(small) == both):
                    found = np.isin(v[p], u)
                    m, deletions = J.segments(int(np.searchsorted(J._LOWS, len(big), side="right")) - 1)
                    assert found.any() if deletions else found.sum() >= m - J.differ(len(big), len(big)), (n, removed)


def test_repeated_ids_and_empty(spark):
    text = " ".join(f"x{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text + " y"), (2, "something else entirely here now ok"), (3, "something else entirely here now ok")]
    got = sorted((x.doc_id, x.component_id) for x in J.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (2, 1), (3, 1)]
    assert J.joined(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_smallest_sets(spark):
    """Sets of 4 shingles against sets of 5, and all small sizes against brute force."""
    text, cheap = "a b c d e f g h", "buy now cheap pills " * 40
    rows = [(1, text), (2, text + " i"), (3, cheap), (4, cheap + "today"), (5, "z " + text)]
    r = random.Random(8)
    while len(rows) < 250:
        base = [f"w{r.randrange(2000)}" for _ in range(r.randrange(5, 14))]
        for words in (base, [*base, "more"], ["less", *base], base[1:]):
            rows.append((len(rows) + 1, " ".join(words)))
    got = {x.doc_id: x.component_id for x in J.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[2] == got[1] == got[5] == 1 and got[4] == got[3] == 3
    assert got == brute(rows)


def test_no_count_of_links(spark):
    """links() spans the components only, so no count of links is offered."""
    assert J.joined(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).columns == ["doc_id", "n_shingles", "component_id"]


def test_heads_probe_for_themselves():
    """A slice's first member of a signature is not probed because another member is: segments without shingles would gather unrelated texts."""
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(10**9)}" for _ in range(r.randrange(170, 420))) for _ in range(120)]
    sets = J.shingle_sets(*J.buffers(J.pa.array(texts)))
    own = {}
    for s in sets:
        v, p = J.signatures(s)
        own[int(np.array([s.sum()]).view(np.int64)[0])] = {int(x) for x in (v[p] & np.uint64(J._VALUE))}
    batch = J.pa.RecordBatch.from_arrays([J.pa.array(range(len(texts)), J.pa.int64()), J.pa.array(texts)], names=["doc_id", "text"])
    seen = 0
    for out in J._sign(3)([batch]):
        for kind, values, members in zip(*(out.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if kind == 0:
                wide = np.zeros((len(members) // 8, 8), np.uint8)
                wide[:, :5] = np.frombuffer(values, np.uint8).reshape(-1, 5)
                for x, key in zip(wide.view(np.uint64).ravel().tolist(), np.frombuffer(members, np.int64).tolist(), strict=True):
                    assert bool(x & 1) == (x >> 1 in own[key])
                    seen += 1
    assert seen > 1000


def test_tables_that_are_used_up_go(spark):
    """What a later step has taken in leaves neither its table in the shared folder nor its shuffle files."""
    from pathlib import Path

    from quillgraph.llm.common import shared_dir, written

    folder = Path(shared_dir(spark))
    before = set(folder.iterdir()) if folder.exists() else set()
    docs = spark.createDataFrame([(i, " ".join(f"w{j + i % 3}" for j in range(40))) for i in range(30)], "doc_id long, text string")
    assert J.joined(docs).count() == 30
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert not left & {"jaccard-keys", "jaccard-members", "jaccard-allocated", "jaccard-led", "jaccard-open"}, left
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    written(docs, "kept")
    assert spark.conf.get(key, None) == was


def test_texts_of_members_only_are_shuffled(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    members = spark.createDataFrame([(7, i) for i in (3, 3, 44, 4999, 6000)], "label long, rep long")
    found = J._texts(docs, members)
    assert sorted(map(tuple, found.collect())) == [(3, "text 3"), (44, "text 44"), (4999, "text 4999")]
    hashes = np.array([r.h for r in spark.range(5000).selectExpr("xxhash64(id) AS h").collect()])
    passed = J.passing(hashes, J.bloom(members.selectExpr("xxhash64(rep) AS gram").distinct()))
    assert {3, 44, 4999} <= set(passed.tolist()) and len(passed) < 100
