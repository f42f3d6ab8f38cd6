import math
import random
import zlib
from collections import Counter, defaultdict

from quillgraph.llm import suffix_tree_lm as L
from quillgraph.llm.jaccard_join import _ASCII_LOWER

D = L.DEPTH


def words(text):
    return (text or "").encode().translate(_ASCII_LOWER).split()


def brute(rows):
    """Counts and the tree from their definitions."""
    train = {k for k, (i, _) in enumerate(rows) if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2}
    count = Counter(w for k in train for w in [*words(rows[k][1]), None])
    total, v = sum(count.values()), len(count)
    symbols = lambda w: [0] * D + ([*(b + 1 for b in w), 33] if w is not None else [L._END])
    seen = defaultdict(Counter)
    for w in count:
        s = symbols(w)
        for t in range(D, len(s)):
            for d in range(D + 1):
                seen[tuple(s[t - d : t])][s[t]] += 1
    kept = {}

    def p(context, a):
        if not context:
            return (seen[()][a] + 1) / (sum(seen[()].values()) + L.ALPHABET)
        up, own = context[1:], seen.get(context)
        if not own:
            return p(up, a)
        n = sum(own.values())
        if context not in kept:
            kept[context] = sum(c * math.log(c / n / p(up, x)) for x, c in own.items()) >= L.MARGIN * len(own)
        return (max(own[a] - L.DISCOUNT, 0) + L.DISCOUNT * len(own) * p(up, a)) / n if kept[context] else p(up, a)

    met = [sum(c == m for c in count.values()) for m in (1, 2, 3, 4)]
    less = L.discounts(met)
    saved = sum(less[min(c, 3)] for c in count.values())

    def spelling(w):
        s = symbols(w)
        return math.prod(p(tuple(s[t - D : t]), s[t]) for t in range(D, len(s)))

    def empty(w):
        return ((count[w] - less[min(count[w], 3)]) + saved * spelling(w)) / total if total else spelling(w)

    after, alone = defaultdict(Counter), defaultdict(Counter)
    contexts = lambda w: zip(["<", "<", *w], ["<", *w], w, strict=False)
    for k in train:
        for x, y, w in contexts([*words(rows[k][1]), None]):
            after[x, y][w] += 1
            alone[y][w] += 1
    single = {c for c, own in alone.items() if sum(n * math.log(n / sum(own.values()) / empty(w)) for w, n in own.items()) >= L.MARGIN * len(own)}

    def one(y, w):
        if y not in single:
            return empty(w)
        own = alone[y]
        return (max(own[w] - L.DISCOUNT, 0) + L.DISCOUNT * len(own) * empty(w)) / sum(own.values())

    retained = {c for c, own in after.items() if sum(n * math.log(n / sum(own.values()) / one(c[1], w)) for w, n in own.items()) >= L.MARGIN * len(own)}

    def token(x, y, w):
        if (x, y) not in retained:
            return one(y, w)
        own = after[x, y]
        return (max(own[w] - L.DISCOUNT, 0) + L.DISCOUNT * len(own) * one(y, w)) / sum(own.values())

    out = {}
    for k, (_, t) in enumerate(rows):
        w = [*words(t), None]
        base = sum(math.log10((count[x] + 1) / (total + v + 1)) for x in w)
        out[k] = (k not in train, len(w), sum(count[x] > 0 for x in w), total, base, sum(math.log10(token(*x)) for x in contexts(w)))
    if total:
        some = next(c for c in seen if len(c) == 2)
        assert abs(sum(p(some, a) for a in range(1, 258)) - 1) < 1e-9
        c = next(iter(retained))
        assert sum(token(*c, w) for w in count) <= 1 + 1e-9
        assert 0 < len(retained) < len(after)
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 2000)
    monkeypatch.setattr(L, "SLICE", 300)
    monkeypatch.setattr(L, "FREQUENT", 40)
    monkeypatch.setattr(L, "FREQUENT_ALONE", 40)
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["the", "of", "Re", "tion", "é", "x" * r.randrange(1, 4)]) + r.choice(["", "ed", "ing"]) for _ in range(r.randrange(0, 40)))) for i in range(150)]
    rows += [(150, None), (151, ""), (152, " \t\n"), (None, "no id"), (3, rows[3][1]), (154, "\x00\x01 ÿ 🙂" * 30)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, score int")
    got = L.scored(docs, L.F.pmod(L.F.crc32(L.F.coalesce(L.F.col("doc_id").cast("string"), L.F.lit("")).cast("binary")), L.F.lit(7)) != 2).collect()
    have = sorted(((x.doc_id is None, x.doc_id or 0), x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) for x in got)
    want = sorted(((i is None, i or 0), *x) for (i, _), x in zip(rows, brute(rows).values(), strict=True))
    assert len(have) == len(want)
    for h, w in zip(have, want, strict=True):
        assert h[:5] == w[:5]
        assert abs(h[5] - w[5]) < 1e-6 * max(1, abs(w[5])) and abs(h[6] - w[6]) < 1e-5 * max(1, abs(w[6]))


def test_held_out_accuracy(spark):
    """Texts not learnt from are likelier by the tree than by the base, in all, and most of the larger table's one by one."""
    for sf, least in (("sf0.01", 0.3), ("sf0.1", 0.5)):
        got = L.op6_suffix_tree_lm(spark, f"/root/testdata/{sf}").toPandas()
        out = got[got.held_out]
        assert len(out) and out.score.sum() > out.base_score.sum()
        assert (out.score > out.base_score).mean() > least, (out.score > out.base_score).mean()
        inside = got[~got.held_out]
        assert inside.score.sum() > inside.base_score.sum()


def test_without_training(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.scored(docs, L.F.lit(False)).collect()}
    assert got[1].n_tokens == 3 and got[1].train_tokens == got[1].n_known == 0 and math.isfinite(got[1].score) and got[1].score < got[2].score < 0


def test_long_text_in_blocks(spark, monkeypatch):
    """A long text is a block of its own, scored whole; how texts are dealt to blocks changes nothing."""
    monkeypatch.setattr(L, "BLOCK", 1 << 16)
    text = " ".join(f"w{(i * 7919) % 5003}" for i in range(60_000))
    rows = [(1, text), *[(i, f"w{i} and w{i + 1}") for i in range(2, 200)], (200, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [{r.doc_id: (r.n_tokens, round(r.score, 3)) for r in L.scored(d, L.F.col("doc_id") % 3 > 0).collect()} for d in (docs.coalesce(1), docs.repartition(6))]
    assert got[0] == got[1] and got[0][1] == got[0][200] and got[0][1][0] == 60_001


def test_empty(spark):
    assert L.scored(spark.createDataFrame([], "doc_id long, text string"), L.F.lit(True)).count() == 0
