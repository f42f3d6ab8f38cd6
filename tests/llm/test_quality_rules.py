import math
import random
import re
from collections import Counter, defaultdict

import duckdb

from quillgraph.llm import quality_rules as Q


def brute(rows):
    base, hists, refs = [], [], defaultdict(lambda: (Counter(), Counter()))
    for _, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wins = Counter(zip(w, w[1:], w[2:]))
        rep = {i + j for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        g = lang if lang in Q.COMMON_WORDS else "other"
        chars = Counter({k: len(re.findall(of, t)) for k, of in Q.CLASSES.items()})
        chars["rest"] = len(t) - sum(chars.values())
        vocab = Q.COMMON_WORDS.get(g) or {x for ws in Q.COMMON_WORDS.values() for x in ws}
        words = Counter(x.lower() if x in (x.lower(), x.capitalize()) and x.lower() in vocab else "" for x in w)
        base.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), failed))
        hists.append((g, chars, words))
        if not failed:
            refs[g][0].update(chars)
            refs[g][1].update(words)

    def far(p, q):
        a, b = sum(p.values()), sum(q.values())
        if not a or not b:
            return 0
        m = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0
        return math.sqrt(max(0, sum(m(p[k] / a, q[k] / b) + m(q[k] / b, p[k] / a) for k in {*p, *q}) / 2))

    out = []
    for b, (g, c, w), (_, t, _) in zip(base, hists, rows, strict=True):
        bad = len(t or "") >= Q.MIN_CHARS and far(c, refs[g][0]) > Q.MAX_CHAR_DISTANCE or b[0] >= Q.MIN_WORDS and far(w, refs[g][1]) > Q.MAX_WORD_DISTANCE
        out.append((*b, not b[5] and not bad))
    return out


def test_against_brute_force(spark):
    r = random.Random(8)
    rows = [(0, None, "en"), (1, "", None), (2, " \n\t", "fr"), (3, "a b c " * 40, "en"), (4, "x y\nx y\n\nx y \n", "de"), (5, "THE " * 200, "en"), (5, "### $$$ " * 90, "xx"), (7, "the of and to in " * 9 + "q", "en"), (None, "the end. " * 60, "en"), (8, "é" * 90000, None)]
    for i in range(60):
        lang = r.choice([*Q.COMMON_WORDS, None])
        vocab = [*Q.COMMON_WORDS.get(lang, ["zu"]), *("".join(r.choice("abcdéü") for _ in range(4)) for _ in range(60))]
        rows.append((100 + i, "".join((w.capitalize() if r.random() < 0.2 else w) + r.choice([" ", " ", ". ", "\n", " ", "### "]) for w in r.choices(vocab, k=r.randrange(0, 300))), lang))
    rows += [(200 + i, " ".join(r.choice(["###zu", "the$$$", "QQ|", "<<of"]) + str(r.randrange(99)) for _ in range(150)), "en") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", Q.F.lit("clash"))
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = sorted(((i is None, i or 0), *x) for (i, _, _), x in zip(rows, brute(rows), strict=True))
    for found in (Q.verdicts(docs), Q.judge(docs)):
        assert sorted(((x.doc_id is None, x.doc_id or 0), *(x[c] for c in cols)) for x in found.collect()) == want
    assert any(x[-1] for x in want) and any(not x[-1] and not x[-2] for x in want)
    assert Q.judge(docs.limit(0)).count() == 0


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert sorted(con.sql(Q.ORACLE_SQL).fetchall()) == sorted(tuple(x) for x in Q.op4_quality_rules(spark, d).collect())
    plan = Q.op4_quality_rules(spark, d)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
