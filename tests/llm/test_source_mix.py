import re

from quillgraph.llm import source_mix as M


def brute_targets(size):
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(size.values()), {}
    while True:
        open_ = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 3 * size[s]]
        if not over:
            return stopped | share
        stopped |= {s: 3 * size[s] for s in over}
        if len(stopped) == len(names):
            return stopped


def test_against_brute_force(spark):
    rows = [(i, ["b", "a", "c", None, "é", "zz"][i % 6 if i % 4 else 0], "w " * (i * 7 % 90 + 1)) for i in range(900)]
    rows += [(900, "tiny", "only three words"), (901, "void", None), (902, "void", ""), (5, "a", "again again"), (5, "a", "again again"), (None, "a", "no id here")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", M.F.lit("clash"))
    got = M.plan(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for _, s, t in rows:
        size[s] = size.get(s, 0) + len(re.findall(M.WORD, t or ""))
    want = brute_targets(size)
    assert abs(sum(want.values()) - sum(size.values())) < 1e-6
    taken = {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == size[r.source]
        assert r.taken in [k * r.size for k in range(4)]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 100, (s, taken[s], t)
    assert sorted(map(str, M.plan(docs).collect())) == sorted(map(str, got))
    assert M.mix(docs).count() == sum(r.copies for r in got)


def test_tree_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK_ROWS", 7)
    monkeypatch.setattr(M, "FANOUT", 3)
    docs = spark.createDataFrame([(i, "ab"[i % 3 == 0], "w " * (i % 40 + 1)) for i in range(400)], "doc_id long, source string, text string")
    got = M.plan(docs).collect()
    assert len(got) == 400
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4 * 40
        assert abs(sum(r.copies for r in own) - len(own) * own[0].target / own[0].source_size) < 1


def test_pivot_keeps_expectation():
    total = [0.0] * 5
    p = [0.3, 0.7, 0.5, 0.9, 0.2]
    for k in range(4000):
        out = M.pivot([k * 5 + i for i in range(5)], p, 0)
        assert sum(x not in (0.0, 1.0) for x in out) <= 1
        total = [a + b for a, b in zip(total, out, strict=True)]
    assert all(abs(t / 4000 - x) < 0.03 for t, x in zip(total, p, strict=True))


def test_reruns_with_tied_ids(spark):
    """Rows that share ids, texts and sizes in several sources or extra columns get the same plan however they are dealt."""
    rows = [(i % 30 if i % 5 else None, "abc"[i % 3], "w " * (i % 30 + 1), i % 2) for i in range(180)] + [(1, "a", "long " * 200_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copies int")
    key = lambda df: sorted(map(str, df.collect()))
    plans = [key(M.plan(x).drop("_u")) for x in (docs, docs.repartition(7), docs.orderBy(M.F.desc("text"), "copies").coalesce(1))]
    assert plans[0] == plans[1] == plans[2] and len(plans[0]) == 181
    mixes = [key(M.mix(x).select("doc_id", "source", "copies", M.F.md5("text"))) for x in (docs, docs.repartition(5, "source"))]
    assert mixes[0] == mixes[1] and len(mixes[0]) == sum(r.copies for r in M.plan(docs).collect())


def test_empty(spark):
    assert M.plan(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
