import io
import itertools
import json
import random
import time
import zipfile

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions.tools import ToolBox, tool_loop
from quillgraph.operators import clinical, fusion, ingest, reference_docs, scoring, tabular, vector
from quillgraph.plans.engine import Engine, QueryParam
from quillgraph.sources import files
from quillgraph.streaming import operators as S


def test_rate_limit_rejects_are_not_recorded():
    ok, window = S.admitted([0.0] * 10 + [30.0, 60.0, 60.1, 61.0])
    assert ok == [True] * 10 + [False, False, True, True] and len(window) == 2


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    r = random.Random(1)
    rows = sorted((f"k{r.randrange(3)}", float(r.randrange(300)), i) for i in range(200))
    df = spark.createDataFrame(rows, "key string, ts double, id long")
    df.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    want = sorted(S.rate_limit(df).collect())
    q = S.rate_limit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.sql("SELECT key, ts, id, allowed FROM limited").collect()) == want


def test_markdown_chunks():
    cut = lambda t, **k: ingest.split_markdown(t, k.pop("most", 8), 2, **k)
    assert cut("no heading at all") == [(0, 4, "no heading at all", None)]
    assert cut("") == [] and [c[3] for c in cut("# one\nonly text here")] == [None]
    assert cut("intro words\n# A\na b\n## B\nc d\n# C\ne f") == [(0, 2, "intro words", ""), (1, 3, "# A\na b", "# A"), (2, 3, "## B\nc d", "# A > ## B"), (3, 3, "# C\ne f", "# C")]
    # an undersized section joins the next by its own size, under the higher heading
    assert cut("# A\na\n## B\nb\n# C\nc d e f g", least=5, fallback=1.0) == [(0, 8, "# A\na\n\n## B\nb\n\n# C\nc d e f g", "# C")]
    assert [c[3] for c in cut("## A\na\n# B\nb c d e f g\n# C\nc", least=4)] == ["# B", "# C"]
    words = " ".join(str(i) for i in range(600))
    long = f"# A\n{words}\n# B\nshort\n# C\nshort"
    got = ingest.split_markdown(long, 300, 20)
    # 302 - 1 tokens of a prefix of one leave 299 a window; the prefix counts
    assert got[0][1] == 300 and got[0][2].startswith("# A\n\n# A\n0 1") and got[1][2].startswith("# A\n\n") and [c[3] for c in got[-2:]] == ["# B", "# C"]
    # where the prefix leaves under 256 tokens it is dropped
    short = ingest.split_markdown(long, 200, 20)
    assert short[0][1] == 200 and short[0][2].startswith("# A\n0 1") and not short[1][2].startswith("#")
    # all sections oversized: windows without paths, unless the share is 1
    every = f"# A\n{words}\n# B\n{words}"
    assert {c[3] for c in ingest.split_markdown(every, 300, 20)} == {None} and {c[3] for c in ingest.split_markdown(every, 300, 20, fallback=1.0)} == {"# A", "# B"}
    assert [c[3] for c in cut("# one\nonly", fallback=1.0)] == ["# one"]
    try:
        cut("x", level=7)
        raise AssertionError
    except ValueError:
        pass


def test_extraction_edges(spark):
    out = '("entity"<|>early<|>t<|>d<|>SOURCE<|>90)##("hyper-relation"<|>bad<|>6.9)##("entity"<|>lost<|>t<|>d<|>SOURCE<|>90)##("hyper-relation"<|>good<|>7)##("entity"<|>in<|>t<|>d<|>odd<|>50)##("entity"<|>low<|>t<|>d<|>SOURCE<|>49)##("entity"<|>five<|>t<|>d<|>90)##("entity"<|>no<|>t<|>d<|>contraindication<|>99)<|COMPLETE|>'
    df = spark.createDataFrame([("c", out)], "chunk_id string, output string")
    edges, nodes = ingest.extraction(df)
    assert [(r.hyperedge, r.weight) for r in edges.collect()] == [("<hyperedge>good", 7.0)]
    assert sorted((r.entity, r.role) for r in nodes.collect()) == [("IN", "CONDITION"), ("NO", "CONTRAINDICATION")]
    assert sorted(r.role for r in ingest.extraction(df, strict=True)[1].collect()) == ["CONDITION", "CONDITION"]


def one_after_the_other(pairs, sets, least):
    """The plain loop: entities merge in the order of their pairs."""
    sets, gone, out = {k: set(v) for k, v in sets.items()}, {}, {}
    for a, b in sorted(pairs):
        if a in gone or b in gone or not sets[a] & sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < least:
            continue
        keep, variant = (a, b) if len(a) >= len(b) else (b, a)
        sets[keep], gone[variant] = sets[a] | sets[b], True
        out[variant] = keep
    return out


def test_resolution_in_rounds_and_in_turn(spark):
    """2,000 random pairs: linked groups in a task each and rounds over all of them give what the plain loop gives."""
    draw = random.Random(8)
    names = [f"{'x' * draw.randrange(1, 9)}{i}" for i in range(700)]
    sets = {n: {f"h{draw.randrange(i // 10, i // 10 + 4)}" for _ in range(draw.randint(1, 5))} for i, n in enumerate(names)}
    pairs = set()
    while len(pairs) < 2000:
        i = draw.randrange(699)
        pairs.add(tuple(sorted((names[i], names[min(699, i + draw.randint(1, 8))]))))
    pairs = {p for p in pairs if p[0] != p[1]}
    inc = spark.createDataFrame([(h, n) for n, hs in sets.items() for h in hs], "hyperedge string, entity string")
    df = spark.createDataFrame(sorted(pairs), "a string, b string")
    want = one_after_the_other(pairs, sets, 0.25)
    assert len(want) > 100 and {(r.variant, r.canonical) for r in ingest.resolve(df, inc).collect()} == set(want.items())
    part = sorted(pairs)[:250]
    rounds = {(r.variant, r.canonical) for r in ingest.resolve(spark.createDataFrame(part, "a string, b string"), inc, most=0).collect()}
    assert rounds == set(one_after_the_other(part, sets, 0.25).items())
    assert ingest.resolve(df.limit(0), inc).collect() == []


def test_resolution_in_steps(spark, monkeypatch):
    """Large groups in few and in many steps, also within the pairs of one entity, are what the plain loop gives; each step decides more than what is first at both its ends."""
    draw = random.Random(9)
    names = [f"{'x' * draw.randrange(1, 4)}{i}" for i in range(60)]
    sets = {n: {f"h{draw.randrange(25)}" for _ in range(draw.randint(1, 5))} for n in names}
    pairs = {tuple(sorted(draw.sample(names, 2))) for _ in range(500)} | {(a, f"y{a}") for a in names}
    sets |= {f"y{a}": set(sets[a]) for a in names[::2]} | {f"y{a}": {"none"} for a in names[1::2]}
    inc = spark.createDataFrame([(h, n) for n, hs in sets.items() for h in hs], "hyperedge string, entity string")
    want = set(one_after_the_other(pairs, sets, 0.25).items())
    written, kept = [], ingest.materialise
    monkeypatch.setattr(ingest, "materialise", lambda df, n: [written.append(n), kept(df, n)][1])
    for step, most in ((10**6, 1), (500, 12)):
        written.clear()
        monkeypatch.setattr(ingest, "STEP", step)
        got = {(r.variant, r.canonical) for r in ingest.resolve(spark.createDataFrame(sorted(pairs), "a string, b string"), inc, most=0).collect()}
        assert got == want and len(want) > 20
        assert written.count("open-pairs") <= most
    assert written.count("open-pairs") > 2


def test_similar_pairs_follow_merges(spark):
    """Names that only come to share a hyperedge through a third one are pairs as well; a large hyperedge is compared in parts."""
    draw = np.random.default_rng(2)
    base = draw.normal(size=(12, 6))
    rows = [(f"n{i:03}", (base[i % 12] + draw.normal(size=6) * 0.15).tolist()) for i in range(120)]
    vectors = spark.createDataFrame(rows, "entity string, vector array<double>")
    inc = [(f"h{i // 4}", n) for i, (n, _) in enumerate(rows)] + [(f"h{(i + 5) // 4}", n) for i, (n, _) in enumerate(rows) if i % 3 == 0] + [("big", n) for i, (n, _) in enumerate(rows) if i % 2]
    v = {n: np.array(x) / np.linalg.norm(x) for n, x in rows}
    alike = lambda a, b: float(v[a] @ v[b]) >= 0.8
    groups = {}
    for h, n in inc:
        groups.setdefault(h, set()).add(n)
    plain = {(a, b) for g in groups.values() for a in g for b in g if a < b and alike(a, b)}
    df = spark.createDataFrame(inc, "hyperedge string, entity string")
    for most in (7, 512):
        assert {tuple(r) for r in ingest.alike_members(df, vectors, 0.8, most).collect()} == plain
    chain = spark.createDataFrame([("h1", "a"), ("h1", "bb"), ("h2", "bb"), ("h2", "c"), ("h3", "d")], "hyperedge string, entity string")
    same = spark.createDataFrame([(n, [1.0, x]) for n, x in (("a", 0.0), ("bb", 0.3), ("c", 0.6), ("d", 0.3))], "entity string, vector array<double>")
    # a and c share nothing, but both are like bb (0.958, 0.954); they are alike at 0.857
    assert {tuple(r) for r in ingest.similar_pairs(chain, same, 0.85).collect()} == {("a", "bb"), ("bb", "c"), ("a", "c")}


def plain_stage(x):
    """The staging rules as plain code."""
    aggr = x["histology_type"] in clinical.AGGRESSIVE or (x["histology_type"] == "endometrioid" and x["grade"] == "G3")
    s, sub, ratio = x["stage_raw"], x["lvsi_substantial"], x["myometrial_invasion_ratio"]
    if s == "II":
        return "IIC" if aggr else "IIB" if sub else "IIA"
    if s in ("IA", "IB"):
        if x["adnexal_involvement"] and not aggr and s == "IA" and (x["myometrial_invasion_depth"] == 0 or ratio == "<50%"):
            return "IA3"
        if aggr:
            return "IIC" if s == "IB" and (x["cervical_involvement"] == "stromal" or sub) else "IC"
        if s == "IA":
            return "IA1" if x["myometrial_invasion_depth"] == 0 else "IIB" if sub else "IA2"
        return "IIB" if ratio == ">=50%" and sub else "IB"
    return {"IIIA": "IIIA1" if x["adnexal_involvement"] else "IIIA2", "IIIB": "IIIB1"}.get(s, s)


def test_base_stage_over_all_values(spark):
    fields = {"histology_type": ["endometrioid", "serous", "unknown"], "grade": ["G1", "G3"], "stage_raw": ["IA", "IB", "II", "IIIA", "IIIB", "IIIC1", "IVB"], "myometrial_invasion_ratio": ["<50%", ">=50%", "unknown"], "cervical_involvement": ["none", "stromal"], "lvsi_substantial": [0, 1], "adnexal_involvement": [0, 1], "myometrial_invasion_depth": [None, 0.0, 3.0]}
    rows = [dict(zip(fields, v, strict=True)) for v in itertools.product(*fields.values())]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "histology_type string, grade string, stage_raw string, myometrial_invasion_ratio string, cervical_involvement string, lvsi_substantial int, adnexal_involvement int, myometrial_invasion_depth double")
    got = df.select(*fields, clinical.base_stage().alias("s")).collect()
    assert all(r.s == plain_stage(r.asDict()) for r in got)


def test_adaptive_cut_against_loop(spark):
    r = random.Random(4)
    lists = {q: sorted((r.choice([r.random(), 0.01, 0.0]) for _ in range(r.randrange(1, 30))), reverse=True) for q in range(60)}
    df = spark.createDataFrame([(q, s, i) for q, v in lists.items() for i, s in enumerate(v)], "query_id long, score double, i long")
    kept = {x.query_id: x.n for x in fusion.adaptive_cut(df).groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    for q, v in lists.items():
        k = min(5, len(v))
        while k < min(20, len(v)) and not (v[k - 1] > 1e-8 and (v[k - 1] - v[k]) / v[k - 1] > 0.5):
            k += 1
        assert kept[q] == k


def test_fusion_ignores_order_and_repeats(spark):
    a = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (1, "x", 2)], "query_id long, item string, rank int")
    b = spark.createDataFrame([(1, "x", 1), (1, "z", 0)], "query_id long, item string, rank int")
    got = {r.item: r.coherence for r in fusion.weighted_fusion(a, b, 0.5).collect()}
    assert got["x"] == round((0.5 / 61 + 0.5 / 62) * 1.2, 4) and got["y"] == round(0.5 / 62, 4)


def test_scalar_functions(spark):
    assert json.loads(X.calculate("-(2 + 3) * abs(-4) / float(2)")) == {"result": -10.0}
    assert "error" in X.calculate("__import__('os')") and "error" in X.calculate("1/0")
    assert X.first_json('note {"a": {"b": 1}} end') == '{"a": {"b": 1}}' and X.first_json("[1, {\"c\": 2}]") == '{"c": 2}' and X.first_json("{bad") is None
    assert X.smart_truncate("a\nkey line\nb", 9, ["key"]).startswith("key line")
    df = spark.createDataFrame([("  &lt;b&gt;\x07é ", "\\u0041b", "AACAPwAAAEA=")], "a string, b string, c string")
    r = df.select(X.clean_text(F.col("a")), X.decode_unicode_escapes("b"), X.decode_vector("c")).first()
    assert (r[0], r[1], list(r[2])) == ("<b>é", "Ab", [1.0, 2.0])


def test_tools(spark):
    box = ToolBox()

    @box.add("search", ["query"])
    def search(query):
        return f"found {query}"

    def respond(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 'look <query>{"query": "a"}</query>' if "<result>" not in t else "done")

    got = tool_loop(spark.createDataFrame([(1, "start")], "id long, text string"), respond, box).first()
    assert got.turns == 2 and "found a" in got.text and got.text.endswith("done")
    assert "result" in box.answer('{"tool": "calculator", "expression": "1+1"}') and "error" in box.answer("x")


def test_scorers(spark):
    r = np.random.default_rng(0)
    d, h = 8, 2
    w = {"heads": h, "scale": 0.1, "roles": r.normal(size=(5, d)), **{g: np.ones(d) for g in ("g0", "g1")}, **{b: np.zeros(d) for b in ("b0", "b1")}, **{m: r.normal(size=(d, d)) for m in ("wq", "wk", "wv", "wo", "q", "k")}, "mlp": [(r.normal(size=(5 * d // h, 4)), np.zeros(4)), (r.normal(size=(4, 1)), np.zeros(1))]}
    m, roles, q = r.normal(size=(3, d)), np.array([0, 1, 2]), r.normal(size=d)
    s = scoring.attention_score(q, m, roles, w)
    assert 0 < s < 1 and abs(s - scoring.attention_score(q, m[::-1], roles[::-1], w)) < 1e-9
    df = spark.createDataFrame([(1, [("a", "EVIDENCE", m[0].tolist())])], "hyperedge long, members array<struct<entity string, role string, vector array<double>>>")
    assert 0 < scoring.hyperedge_scores(df, q, w).first().score < 1
    assert scoring.gate(q, [(np.full((d, 1), 99.0), np.zeros(1))]) in (0.02, 0.98)
    assert scoring.pair_scores(m, m, [(np.zeros((4 * d, 1)), np.zeros(1))]).tolist() == [0.5] * 3


def test_quantise_constant(spark):
    df = spark.createDataFrame([([2.0, 2.0],), ([0.0, 1.0],)], "v array<double>").withColumn("p", vector.quantise("v"))
    assert [r[0] for r in df.select(vector.dequantise("p")).collect()] == [[2.0, 2.0], [0.0, 1.0]]


def test_reference_docs(spark):
    df = spark.createDataFrame([(1, "intro\n## One\nbody a\n## Two\nbody b")], "doc_id long, text string")
    secs = reference_docs.sections(df)
    assert [(r.heading, r.content) for r in secs.orderBy("pos").collect()] == [(reference_docs.PREAMBLE, "intro"), ("One", "body a"), ("Two", "body b")]
    assert reference_docs.keyword_sections(secs, ["BODY B"]).count() == 1 and reference_docs.keyword_sections(secs, ["none"]).count() == 3


def test_labels_fit(spark):
    df = spark.createDataFrame([(float(i % 10), int(i % 10 > 6)) for i in range(200)], "x double, y int")
    model = tabular.fit_labels(df, ["x"], ["y"], "gbt", maxIter=3, maxDepth=2)["y"]
    assert model.transform(df).filter("prediction <> y").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1}, {"k": 2}]')
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n\n{"k": 3}\n')
    assert files.read_json(spark, str(tmp_path / "a.json")).count() == 2 and files.read_jsonl(spark, str(tmp_path / "b.jsonl")).count() == 2
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda s: f"<w:tc><w:p><w:r><w:t>{s}</w:t></w:r></w:p></w:tc>"
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr>{cell('a')}{cell('a')}{cell('b')}</w:tr></w:tbl></w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "x.docx").write_bytes(out.getvalue())
    (tmp_path / "docs" / "y.pdf").write_bytes(b"%PDF\nstream\nBT (Hi \\(you\\)) Tj ET\nendstream")
    (tmp_path / "docs" / "z.docx").write_bytes(b"broken")
    got = {r.id: (r.raw_text, r.status.split(":")[0]) for r in files.read_folder(spark, str(tmp_path / "docs")).collect()}
    assert got == {"x": ("Hello\na | b", "ok"), "y": ("Hi (you)", "ok"), "z": ("", "error")}
    (tmp_path / "g.graphml").write_text('<graphml><graph><node id="&quot;A&quot;"><data key="d0">t</data></node><edge source="A" target="B"><data key="d3">1.5</data></edge></graph></graphml>')
    nodes, edges = files.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert nodes.first().id == "A" and nodes.first().entity_type == "t" and edges.first().weight == 1.5


def test_engine_round_trip(spark, tmp_path):
    def embed(texts):
        return [[float(len(t)), float(t.count("a")), 1.0] for t in texts]

    def complete(chunks: pd.Series) -> pd.Series:
        return chunks.map(lambda c: f'("hyper-relation"<|>{c}<|>8)##("entity"<|>{c.split(" ")[0]}<|>t<|>d<|>SOURCE<|>80)##("entity"<|>shared<|>t<|>d<|>ACTION<|>80)<|COMPLETE|>')

    e = Engine(spark, str(tmp_path / "kg"), embed, 3, complete, resolve=None)
    e.insert(spark.createDataFrame([("alpha fact",), ("alpha fact",)], "text string"), "p1")
    e.insert(spark.createDataFrame([("beta other fact",), ("alpha fact",)], "text string"), "p2")
    assert e.store.read("full_docs").count() == 2 and e.store.read("hyperedges").count() == 2
    got = e.query(spark.createDataFrame([(1, "alpha fact")], "query_id long, text string"), QueryParam(top_k=5)).orderBy("rank").collect()
    assert len(got) == 2 and got[0].coherence >= got[1].coherence
    paths = e.context(spark.createDataFrame([(1, "alpha fact")], "query_id long, text string"), 5).orderBy("rank").collect()
    assert {r.paper for r in paths} == {"p1", "p2"} and all("alpha fact" in r.text or "beta other fact" in r.text for r in paths)
    lexical = e.query(spark.createDataFrame([(1, "alpha fact")], "query_id long, text string"), QueryParam(top_k=5, ablation="bm25_vector_only")).collect()
    assert lexical and {r.coherence for r in lexical} == {0.8}
    try:
        e.query(spark.createDataFrame([(1, "alpha")], "query_id long, text string"), QueryParam(ablation="none"))
        raise AssertionError
    except ValueError:
        pass
    status = {r.entity: r.status for r in e.delete_document("p2").collect()}
    assert status == {"BETA": "orphaned", "SHARED": "shared"}
    assert e.store.read("vec_hyperedges").count() == 1 and {r.name for r in e.store.read("vec_entities").collect()} == {"ALPHA", "SHARED"}
    e.delete_entity("alpha")
    assert e.store.read("incidence").count() == 1
    e.delete_hyperedge("alpha fact")
    assert e.store.read("incidence").count() == 0 == e.store.read("hyperedges").count()


def test_tags_are_quoted_and_names_cleaned(spark):
    out = '(hyper-relation<|>no tag<|>9)##("hyper-relation"<|> fact &amp; x<|>9)##(entity<|>no<|>t<|>d<|>SOURCE<|>90)##("entity"<|>a &lt; b<|>t<|>d<|>"Action"<|>90)'
    edges, nodes = ingest.extraction(spark.createDataFrame([("c", out)], "chunk_id string, output string"))
    assert [r.hyperedge for r in edges.collect()] == ["<hyperedge>fact & x"]
    assert [(r.hyperedge, r.entity, r.role) for r in nodes.collect()] == [("<hyperedge>fact & x", "A < B", "RECOMMENDATION")]


def test_empty_texts_have_no_chunks(spark):
    docs = spark.createDataFrame([("a", ""), ("b", None), ("c", "x y")], "doc_id string, content string")
    assert [(r.full_doc_id, r.tokens) for r in ingest.chunks(docs).collect()] == [("c", 2)]
    assert ingest.markdown_chunks(docs).select("full_doc_id").collect() == [("c",)]


def test_entities_merge_with_stored_ones(spark):
    stored = spark.createDataFrame([("E", "old", "d1<SEP>d2"), ("F", "kept", "x")], "entity string, entity_type string, description string")
    rows = spark.createDataFrame([("E", "new", "d3", 1), ("E", "old", "d1", 2), ("G", "g", "y", 3)], "entity string, entity_type string, description string, pos int")
    got = {r.entity: (r.entity_type, r.description, r.n) for r in ingest.merge_entities(rows, stored).collect()}
    assert got == {"E": ("old", "d1<SEP>d2<SEP>d3", 3), "G": ("g", "y", 1)}
    tie = ingest.merge_entities(rows.filter("pos = 1"), stored).first()
    assert tie.entity_type == "old"


def test_closure_of_circles(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "c"), ("p", "q"), ("q", "r"), ("s", "s")]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "variant int, canonical int")
    for most in (0, None):  # in rounds, and in one task
        got = {r.variant: r.root for r in ingest.closure(spark.createDataFrame(pairs, "variant string, canonical string"), most).collect()}
        assert got == {"b": "a", "c": "a", "x": "a", "p": "r", "q": "r"}
        assert {r.root for r in ingest.closure(chain, most).collect()} == {40}


def test_component_labels(spark):
    from quillgraph.operators import graph

    edges = spark.createDataFrame([(9, 4), (4, 7), (2, 3), (3, 2), (5, 5), (11, 10), (10, 7)], "src int, tgt int")
    want = {9: 4, 4: 4, 7: 4, 10: 4, 11: 4, 2: 2, 3: 2}
    for most in (0, None):
        assert {r.node: r.c for r in graph.component_labels(edges, most).collect()} == want
    assert graph.component_labels(edges.limit(0)).collect() == []


def test_component_rounds_shrink(spark, monkeypatch):
    """Against the plain loop, on paths, stars and random graphs in odd orders; after the first round few edges are left."""
    from quillgraph.operators import graph

    draw = random.Random(3)
    name = list(range(900))
    draw.shuffle(name)
    pairs = [(name[i], name[i + 1]) for i in range(200)] + [(name[300], name[i]) for i in range(301, 400)] + [(name[draw.randrange(400, 700)], -name[draw.randrange(400, 900)] - 1) for _ in range(900)]
    want = dict(graph._connected(pd.DataFrame(pairs, columns=["src", "tgt"])).itertuples(index=False))
    sizes, kept = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, n: [out := kept(df, n), sizes.append(out.count()) if n == "component-edges" else None][0])
    for most in (0, 40):
        sizes.clear()
        assert {r.node: r.c for r in graph.component_labels(spark.createDataFrame(pairs, "src int, tgt int"), most).collect()} == want
        assert len(sizes) > 1 and all(b < a for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[2] < sizes[0] / 4


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    from quillgraph import session

    rows = spark.range(100)
    assert session.dealt(rows, "id").rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    assert session.dealt(rows, "id").rdd.getNumPartitions() == 10 and session.dealt(rows, "id", n=150).rdd.getNumPartitions() == 15


def test_hard_negatives_where_anchors_are_read(spark):
    """The first of other topics by hash, with a repeated anchor; anchors are not sent to the task that holds the few."""
    import hashlib

    from quillgraph.operators import curation

    anchors = [(i % 45, i % 4 if i % 9 else None) for i in range(50)]
    facts = [(i, i % 4, "RECOMMENDATION" if i % 3 else "EVIDENCE") for i in range(60)]
    found = curation.hard_negatives(spark.createDataFrame(anchors, "anchor_id int, topic int"), spark.createDataFrame(facts, "hyperedge int, topic int, role string"), 2)
    md5 = lambda x: hashlib.md5(str(x).encode()).hexdigest()
    few = [(h, t) for t in range(4) for h in sorted((h for h, u, r in facts if u == t and r == "RECOMMENDATION"), key=lambda h: (md5(h), h))[:2]]
    met = {}
    for a, t in anchors:
        met.setdefault(a, []).extend((md5(f"{a}:{h}"), h) for h, u in few if t is not None and u != t)
    assert sorted(tuple(r) for r in found.collect()) == sorted((a, h) for a, x in met.items() for _, h in sorted(x)[:2])
    assert "NOT (_t" not in found._jdf.queryExecution().executedPlan().toString()


def test_hard_negatives_of_all_candidates(spark, monkeypatch):
    """The first of all recommendations for another topic, with and without a bound, in one block and in many; anchors that the bound leaves short are completed."""
    import hashlib

    from quillgraph.operators import curation

    anchors = [(i % 45, i % 4 if i % 9 else None) for i in range(50)]
    facts = [(i, i % 4, "RECOMMENDATION" if i % 3 else "EVIDENCE") for i in range(900)] + [(5, 1, "RECOMMENDATION")]
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    met = {}
    for a, t in anchors:
        met.setdefault(a, []).extend((md5(f"{a}:{h}"), h) for h, u in {(h, u) for h, u, r in facts if r == "RECOMMENDATION"} if t is not None and u != t)
    frames = spark.createDataFrame(anchors, "anchor_id int, topic int"), spark.createDataFrame(facts, "hyperedge int, topic int, role string")
    for most, k in ((4096, 2), (16, 2), (64, 30), (4096, 700)):
        monkeypatch.setattr(curation, "MET", most)
        want = sorted((a, h) for a, x in met.items() for _, h in sorted(x)[:k])
        assert sorted(tuple(r) for r in curation.hard_negatives_of_all(*frames, k).collect()) == want


def test_second_hop_ranks_pairs_before_they_move(spark):
    from quillgraph.operators import graph

    inc = [(h, e, "RECOMMENDATION" if h % 2 else "EVIDENCE") for h in range(20) for e in {h % 3, h % 5 + 10, h % 7 + 20}]
    starts = [(h, h / 10) for h in range(20)]
    found = graph.second_hop(spark.createDataFrame(inc, "hyperedge int, entity int, role string"), spark.createDataFrame(starts, "hyperedge int, score double"), 0.5, 3)
    at = lambda h: {e for g, e, _ in inc if g == h}
    want = {(h, t, s / 2) for h, s in starts for t in sorted(t for t in range(1, 20, 2) if t != h and at(t) & at(h))[:3]}
    assert {tuple(r) for r in found.collect()} == want and "dense_rank" in found._jdf.queryExecution().executedPlan().toString()


def test_stages_with_classes(spark):
    from pyspark.sql import functions as F

    texts = ["FIGO分期：IAmPOLEmut", "figo分期: IIIC1ii then IB", "was IB, now IIIC2.", "none"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.stage_of(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == ["IAmPOLEmut", "IIIC1ii", "IIIC2", None]


def test_tables_are_shared_between_stores(spark, tmp_path):
    """Versions live in the folder: another store on it goes on where the first one was; a write that was cut off does not count."""
    from quillgraph.operators.store import TableStore

    one, two = TableStore(spark, str(tmp_path)), TableStore(spark, str(tmp_path))
    assert not two.exists("t")
    one.upsert("t", spark.createDataFrame([(1, "a")], "id int, v string"), "id")
    assert two.exists("t") and two.upsert("t", spark.createDataFrame([(1, "z"), (2, "b")], "id int, v string"), "id").count() == 2
    (tmp_path / "t" / "v9").mkdir()
    assert sorted((r.id, r.v) for r in one.read("t").collect()) == [(1, "a"), (2, "b")]
    one.upsert("t", spark.createDataFrame([(3, "c")], "id int, v string"), "id")
    assert two.read("t").count() == 3 and len(two.versions("t")) == 2


def test_nearest_against_loop(spark, monkeypatch):
    """Queries that travel with the plan and queries joined in blocks give what a loop over all pairs gives, ties by id."""
    draw = np.random.default_rng(3)
    points = [[float(x) for x in draw.integers(-2, 3, 4)] for _ in range(130)] + [[0.0] * 4] + [[1.0, 2.0, 0.0, 1.0]] * 60
    rows = spark.createDataFrame([(f"n{i % 100}" if i % 7 else f"é{i}", p) for i, p in enumerate(points)] + [("none", None), (None, [1.0] * 4)], "id string, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(f"n{i}", p) for i, p in enumerate(points[::4])], "query_id string, vector array<float>")
    ids = [(f"n{i % 100}" if i % 7 else f"é{i}", np.array(p)) for i, p in enumerate(points)]
    cost = {"manhattan": lambda q, v: float(np.abs(v - q).sum()), "euclidean": lambda q, v: float(np.sqrt(((v - q) ** 2).sum())), "cosine": lambda q, v: -float(q @ v) / (np.linalg.norm(q) * np.linalg.norm(v)) if q.any() and v.any() else 0.0}
    for metric, own, worst in (("manhattan", True, np.inf), ("cosine", False, -0.3), ("euclidean", False, np.inf)):
        want = set()
        for i, p in enumerate(points[::4]):
            line = sorted((round(cost[metric](np.array(p), v), 9), n) for n, v in ids if not (own and n == f"n{i}"))
            want |= {(f"n{i}", k + 1, c) for k, (c, n) in enumerate(line[:9]) if c <= worst}
        for block, size in ((7, 40), (1000, 40)):
            monkeypatch.setattr(vector, "QUERY_BLOCK", block)
            monkeypatch.setattr(vector, "BLOCK", size)
            monkeypatch.setattr(vector, "PAIRS", 100)
            got = vector.nearest(asked, rows, 9, metric, worst, own).collect()
            assert {(r.query_id, r["rank"], round(r.cost, 9) + 0.0) for r in got} == want
            if metric != "cosine":  # sums without rounding: ties are exact
                assert {(r.query_id, r["rank"], r.id) for r in got} == {(f"n{i}", k + 1, n) for i, p in enumerate(points[::4]) for k, (c, n) in enumerate(sorted((cost[metric](np.array(p), v), n) for n, v in ids if not (own and n == f"n{i}"))[:9])}


def test_more_queries_than_a_block(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 5), float(i), 1.0]) for i in range(60)], "id long, vector array<double>")
    near = tabular.nearest(rows.selectExpr("id AS query_id", "vector AS features"), rows.withColumnRenamed("vector", "features"), 1)
    assert all(r.id == r.query_id for r in near.collect())
    assert vector.top_k(rows.limit(0).withColumnRenamed("id", "query_id"), rows, 3).count() == 0 == vector.top_k(rows.withColumnRenamed("id", "query_id"), rows.limit(0), 3).count()


def test_matches_of_an_earlier_batch(spark):
    """A new name is a stored one if they share a hyperedge, or if their hyperedges are alike; of the nearest the first that is."""
    vec = lambda rows: spark.createDataFrame(rows, "entity string, vector array<double>")
    inc = lambda rows: spark.createDataFrame(rows, "hyperedge string, entity string")
    new = vec([("N1", [1.0, 0.0]), ("N2", [0.0, 1.0]), ("N3", [1.0, 1.0])])
    stored = vec([("A", [1.0, 0.01]), ("B", [1.0, 0.02]), ("C", [0.01, 1.0])])
    vectors = spark.createDataFrame([("h1", [1.0, 0.0]), ("h2", [0.0, 1.0]), ("h3", [0.1, 1.0]), ("h4", [1.0, -1.0])], "hyperedge string, vector array<double>")
    got = ingest.earlier_matches(new, stored, inc([("h1", "N1"), ("h2", "N2"), ("h4", "N3")]), inc([("h4", "A"), ("h1", "B"), ("h3", "C")]), vectors)
    assert {r.entity: r.canonical for r in got.collect()} == {"N1": "B", "N2": "C"}


def test_models_by_fold_and_on_disk(spark, tmp_path):
    from quillgraph.operators import prepare, tabular

    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), int(i % 7 > 3), int(i % 3 == 0)) for i in range(120)], "id int, a double, b double, y int, z int")
    got = tabular.cross_validated(df, ["a", "b"], ["y", "z"], "id", 3, "forest", numTrees=5, maxDepth=4)
    metrics = {r.metric: r.mean for r in prepare.over_folds(prepare.label_metrics(got, 2), ["accuracy", "macro_f1"]).collect()}
    assert got.count() == 120 and metrics["accuracy"] > 0.9 and metrics["macro_f1"] > 0.9
    models = tabular.fit_labels(df, ["a", "b"], ["y"], "forest", numTrees=3)
    tabular.save_models(models, str(tmp_path))
    again = tabular.load_models(str(tmp_path), ["y"])
    pick = lambda m: [r.prediction for r in m["y"].transform(df).orderBy("id").collect()]
    assert pick(models) == pick(again)


def test_reranker(spark):
    from quillgraph.operators.scoring import reranker_udf

    rank = reranker_udf(lambda qs, ts: [float(len(t) - len(q)) for q, t in zip(qs, ts, strict=True)])
    assert [r[0] for r in spark.createDataFrame([("a", "bcd"), (None, "x")], "q string, t string").select(rank("q", "t")).collect()] == [2.0, 1.0]


def test_bm25_and_vector_without_the_graph(spark):
    from quillgraph.operators import evidence

    docs = spark.createDataFrame([("d1", ["a", "b"]), ("d2", ["c"]), ("d3", ["x", "y"]), ("d4", ["z"])], "item string, tokens array<string>")
    asked = spark.createDataFrame([(1, ["a"])], "query_id long, tokens array<string>")
    hits = spark.createDataFrame([(1, "v", 1), (1, "d1", 0)], "query_id long, item string, rank int")
    got = [(r.item, r.coherence) for r in evidence.bm25_and_vector(docs, asked, hits).orderBy("rank").collect()]
    assert got == [("d1", 0.8), ("v", 0.8)]


def test_ingest_stream(spark, tmp_path):
    from quillgraph.operators.store import TableStore

    spark.createDataFrame([("a",), ("b",), ("a",)], "text string").write.parquet(str(tmp_path / "in"))
    store = TableStore(spark, str(tmp_path / "out"))
    for _ in range(2):
        S.ingest_stream(spark.readStream.schema("text string").parquet(str(tmp_path / "in")), store, "docs", str(tmp_path / "c")).awaitTermination(120)
    assert store.read("docs").count() == 2


def test_parents_count_all_their_hyperedges(spark):
    """Hyperedges without a positive score give no coverage, but their roles and number count."""
    from quillgraph.operators import evidence, graph

    belongs = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c"), ("q", "d"), ("r", "b"), ("r", "e")], "paper string, hyperedge string")
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.0), ("d", 0.6), ("e", -0.2)], "hyperedge string, score double")
    roles = spark.createDataFrame([("a", "x", "CONTEXT", 1.0), ("b", "x", "RECOMMENDATION", 1.0), ("c", "x", "CONTEXT", 1.0), ("d", "x", "EVIDENCE", 1.0), ("e", "x", "EVIDENCE", 1.0)], "hyperedge string, entity string, role string, weight double")
    got = {tuple(r) for r in graph.parent_coverage(belongs, scores, roles).collect()}
    assert got == {("p", 0.5, 3, 3), ("q", 0.6, 2, 1)}
    hits = spark.createDataFrame([(1, "x")], "query_id long, entity string")
    stream = {(r.paper, r.tier, r.coverage, r.n_hyperedges, r["rank"]) for r in evidence.graph_stream(hits, roles, belongs, scores).collect()}
    assert stream == {("p", 3, 0.5, 3, 1), ("q", 2, 0.6, 1, 2)}


def test_what_queries_reach_moves_once(spark, monkeypatch):
    """Scores by hyperedge or by query, few entities or many, give the same texts; what queries reach is shuffled to them and nowhere else."""
    from quillgraph.operators import evidence

    draw = random.Random(12)
    roles = ("CONDITION", "RECOMMENDATION", "EVIDENCE")
    inc = spark.createDataFrame(sorted({(h, e): (h, e, draw.choice(roles)) for h in range(80) for e in draw.sample(range(40), 4)}.values()), "hyperedge int, entity int, role string")
    belongs = spark.createDataFrame([(p, h) for h in range(75) for p in draw.sample(range(9), draw.randint(1, 3))], "paper int, hyperedge int")
    scores = spark.createDataFrame([(h, draw.choice([0.0, 0.25, 0.5, 0.75])) for h in range(70)], "hyperedge int, score double")
    hits = spark.createDataFrame([(q, draw.randrange(45)) for q in range(12) for _ in range(3)], "query_id int, entity int")
    each = scores.crossJoin(hits.select("query_id").distinct())
    found = []
    for few in (1 << 20, 0):
        monkeypatch.setattr(evidence, "FEW_ENTITIES", few)
        for given in (scores, each):
            out = evidence.graph_stream(hits, inc, belongs, given, cap=6, parents=4, paths=2)
            found.append(sorted(tuple(r) for r in out.collect()))
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("RepartitionByExpression") == 1 and plan.count("Join") <= (3 if given is scores else 4)
    assert all(f == found[0] for f in found) and len(found[0]) > 30
    assert all(0 < r[6].count("候选路径") <= 2 and r[6].count("【权威循证溯源") == 1 for r in found[0])


def test_csv_contexts(spark):
    from quillgraph.operators import curation

    rows = spark.createDataFrame([(1, 0, 'id,text\n1,"a\nb",c,d\n\n2,x,y,z\n3\n'), (1, 1, ""), (1, 2, None), (1, 3, "only a header")], "query_id long, list_no int, csv string")
    assert [(r.pos, r.content) for r in curation.contexts_of_csv(rows).orderBy("pos").collect()] == [(0, "a\nb,c,d"), (1, "x,y,z")]


def test_any_positive_can_be_drawn(spark):
    from quillgraph.operators import prepare

    rows = spark.range(5000).selectExpr("id AS anchor_id", "concat('p', id) AS positive", "array('无相关困难负样本') AS hard_negatives")
    got = prepare.random_negatives(rows).collect()
    assert len(got) == 5000 and len({r.negative for r in got}) > 2500 and all(r.negative != f"p{r.anchor_id}" and not r.hard for r in got)
    one = spark.createDataFrame([(1, "p", ["无相关困难负样本"]), (2, "p", [])], "anchor_id long, positive string, hard_negatives array<string>")
    assert {tuple(r) for r in prepare.random_negatives(one).collect()} == {(1, "p", False), (2, "p", False)}


def test_store_grows_by_deltas(spark, tmp_path):
    """An upsert of 1 % writes about 1 % of the bytes; folding changes no row; old versions can be read until they are folded away."""
    from quillgraph.sources import tables

    store = tables.open_store("DeltaStore", spark, str(tmp_path), "w-1")
    rows = spark.range(40_000).selectExpr("id", "sha2(cast(id AS string), 256) AS text", "id % 7 AS n").coalesce(1)
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "t" / "rows").rglob("*.parquet"))
    store.upsert("t", rows, "id")
    whole = size()
    store.upsert("t", rows.filter("id % 100 = 3").selectExpr("id", "concat('new ', text) AS text", "n"), "id", "rows")
    assert size() - whole < 0.03 * whole
    store.delete("t", rows.filter("id % 100 = 4").select("id"))
    assert size() - whole < 0.04 * whole
    want = {(i, ("new " if i % 100 == 3 else "")) for i in range(40_000) if i % 100 != 4}
    seen = lambda df: {(r.id, "new " if r.text.startswith("new ") else "") for r in df.collect()}
    assert seen(store.read("t")) == want and store.read("t", 1).count() == 40_000
    store.upsert("t", rows.filter("id % 100 = 4"), "id")
    store.compact("t")
    assert seen(store.read("t")) == want | {(i, "") for i in range(4, 40_000, 100)} and store.versions("t") == [1, 2, 3, 4, 5]
    store.compact("t")
    assert store.versions("t") == [5, 6] and store.read("t").count() == 40_000
    store.upsert("t", rows.limit(3), "id")
    assert store.versions("t") == [5, 6]  # nothing new, nothing written
    pairs = store.upsert("pairs", spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "p string, q string, v int"), ["p", "q"])
    pairs = store.upsert("pairs", spark.createDataFrame([("a", "y", 9), ("b", "y", 3)], "p string, q string, v int"), ["p", "q"], "rows")
    assert {tuple(r) for r in pairs.collect()} == {("a", "x", 1), ("a", "y", 9), ("b", "y", 3)}
    for bad in (lambda: tables.open_store("none", spark, str(tmp_path)), lambda: tables.DeltaStore(spark, str(tmp_path), "a/b"), lambda: store.read("none")):
        try:
            bad()
            raise AssertionError
        except ValueError:
            pass


def test_workspaces_never_meet(spark, tmp_path):
    from quillgraph.sources.tables import DeltaStore

    one, two = DeltaStore(spark, str(tmp_path), "one"), DeltaStore(spark, str(tmp_path), "007")
    one.upsert("t", spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), "id")
    two.upsert("t", spark.createDataFrame([(1, "x"), (3, "y")], "id int, v string"), "id")
    one.delete("t", spark.createDataFrame([(1,), (3,)], "id int"))
    assert [tuple(r) for r in one.read("t").collect()] == [(2, "b")]
    assert {tuple(r) for r in two.read("t").collect()} == {(1, "x"), (3, "y")}
    plan = two.read("t")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(workspace" in plan and "007" in plan
    two.drop("t")
    assert two.read("t").count() == 0 and one.read("t").count() == 1


def test_two_writers(spark, tmp_path):
    """Who comes second sees what the first has written and tries again; who never comes first is told."""
    from quillgraph.sources.tables import ConcurrentWrite, DeltaStore

    df = lambda *rows: spark.createDataFrame(rows, "id int, v string")
    one, two = DeltaStore(spark, str(tmp_path)), DeltaStore(spark, str(tmp_path))
    one.upsert("t", df((1, "a")), "id")
    real, turns = one._write_rows, []

    def late(name, rows):
        commit = real(name, rows)
        if not turns:
            turns.append(two.upsert("t", df((2, "theirs")), "id"))  # between this writer's rows and its log file
        return commit

    one._write_rows = late
    one.upsert("t", df((2, "mine"), (3, "mine")), "id")
    assert {tuple(r) for r in one.read("t").collect()} == {(1, "a"), (2, "theirs"), (3, "mine")} and one.versions("t") == [1, 2, 3]

    def always(name, rows):
        commit = real(name, rows)
        two.upsert("t", df((10 + len(turns), "theirs")), "id")
        turns.append(None)
        return commit

    one._write_rows = always
    try:
        one.upsert("t", df((3, "late")), "id", "rows")
        raise AssertionError
    except ConcurrentWrite:
        assert {r.v for r in one.read("t").filter("id = 3").collect()} == {"mine"}


def test_engine_resolves_gleans_summarises_and_scores(spark, tmp_path):
    """Two batches and a given graph end to end; both streams against plain loops."""
    import hashlib

    like = {"VBT": "brachy", "VAGINAL BRACHYTHERAPY": "brachy", "<hyperedge>rule one": "rule", "<hyperedge>rule two": "rule"}

    def embed(texts):
        seeds = [int.from_bytes(hashlib.md5(like.get(t, t).encode()).digest()[:4], "big") for t in texts]
        return [np.random.default_rng(x).normal(size=8).tolist() for x in seeds]

    record = lambda name, role, about="d": f'("entity"<|>{name}<|>t<|>{about}<|>{role}<|>80)##'
    said = {
        "one": '("hyper-relation"<|>rule one<|>8)##' + record("vbt", "ACTION") + record("vaginal brachytherapy", "INPUT") + record("stage", "INPUT", "word " * 600),
        "two": '("hyper-relation"<|>rule two<|>9)##' + record("vbt", "SOURCE") + record("other", "CONTEXT"),
    }
    weights = {"heads": 2, "scale": 0.1, "mlp": [(np.full((20, 1), 0.3), np.zeros(1))]}
    draw = np.random.default_rng(7)
    weights |= {"roles": draw.normal(size=(5, 8)), "g0": np.ones(8), "g1": np.ones(8), "b0": np.zeros(8), "b1": np.zeros(8)} | {m: draw.normal(size=(8, 8)) for m in ("wq", "wk", "wv", "wo", "q", "k")}
    parts = {
        "glean": (lambda h: h.map(lambda x: record("gleaned", "INPUT")), lambda h: h.map(lambda x: "no")),
        "summarise": lambda t: t.map(lambda x: f"{len(x.split())} words"),
        "rerank": lambda qs, ts: [len(t) % 5 / 10 for t in ts],
        "scorer": weights,
    }
    e = Engine(spark, str(tmp_path / "kg"), embed, 8, lambda c: c.map(said.get), workspace="w", **parts)
    e.insert(spark.createDataFrame([("one",)], "text string"), "p1")
    e.insert(spark.createDataFrame([("two",)], "text string"), "p2")
    incidence = {(r.hyperedge, r.entity): r.role for r in e.store.read("incidence").collect()}
    assert set(incidence) == {(f"<hyperedge>rule {k}", n) for k, names in (("one", ("VAGINAL BRACHYTHERAPY", "STAGE", "GLEANED")), ("two", ("VAGINAL BRACHYTHERAPY", "OTHER", "GLEANED"))) for n in names}
    assert {r.entity: r.description for r in e.store.read("entities").collect()}["STAGE"] == "600 words"
    assert {(r.paper, r.role, r.weight) for r in e.store.read("belongs").collect()} == {("p1", "EVIDENCE", 1.0), ("p2", "EVIDENCE", 1.0)}
    e.insert_graph(spark.createDataFrame([("s", " text of s ")], "source_id string, content string"), spark.createDataFrame([("uterus", "organ", "an organ", "s")], "entity_name string, entity_type string, description string, source_id string"), spark.createDataFrame([("uterus", "stage", "is staged", "staging", 2.0, "s")], "src_id string, tgt_id string, description string, keywords string, weight double, source_id string"))
    custom = "staging UTERUS STAGE is staged"
    asked = spark.createDataFrame([(1, "what stage"), (2, "which organ")], "query_id long, text string")
    got = e.query(asked, QueryParam(top_k=20)).collect()
    assert {(r.query_id, r.knowledge) for r in got} == {(q, k) for q in (1, 2) for k in ("rule one", "rule two", custom)}
    # each text, chunk and store operation is counted, whatever the plans look like
    e.answer(asked, QueryParam(top_k=20)).collect()
    seen = {(r.name, r.kind, r.label): r.value for r in e.metrics.rows(spark).filter("kind <> 'bucket' OR le IS NULL").collect()}
    assert len({n for n, _, _ in seen}) == 17 and seen["llm_calls_total", "counter", "default"] == 2 == seen["llm_call_duration_seconds", "bucket", "default"]
    assert seen["aquery_total", "counter", ""] == 1 == seen["aquery_duration_seconds", "bucket", ""] and seen["aquery_duration_seconds", "sum", ""] > 0 == seen["active_queries", "gauge", ""]
    assert seen["embedding_calls_total", "counter", "default"] >= 12 and seen["graph_operations_total", "counter", "upsert"] >= 14 and seen["retry_total", "counter", ""] == 0
    # the vector stream: the reranker's order of what it scores over its cut
    alone = e.query(asked.limit(1), QueryParam(top_k=20, ablation="vector_only")).orderBy("rank").collect()
    want = [k for s, k in sorted((-(len(k) % 5 / 10), f"<hyperedge>{k}") for k in ("rule one", "rule two", custom)) if s < -0.01]
    assert [r.knowledge for r in alone] == [k.removeprefix("<hyperedge>") for k in want]
    # the graph stream: scores of question and members, summed by paper
    members = {}
    for r in e.store.read("incidence").collect():
        members.setdefault(r.hyperedge, []).append((r.entity, r.role))
    vectors = {r.name: np.array(r.vector, float) for r in e.store.read("vec_entities").collect()}
    for r in e.context(asked, 20).collect():
        rule = {"p1": "<hyperedge>rule one", "p2": "<hyperedge>rule two"}[r.paper]
        own = sorted(members[rule])
        q = np.array(np.float32(embed(["what stage", "which organ"][r.query_id - 1 : r.query_id])[0]), float)
        score = scoring.attention_score(q, np.array([vectors[n] for n, _ in own]), np.array([scoring.ROLE_IDS[x] for _, x in own]), weights)
        roles = {x for _, x in own}  # of names that merge in a hyperedge the role written last stays
        assert (r.tier, r.n_hyperedges) == (3 if "RECOMMENDATION" in roles else 2 if "EVIDENCE" in roles else 1, 1) and abs(r.coverage - round(score, 4)) < 2e-4 and rule in r.text


def test_containment_against_loop(spark):
    """Needles of every length, repeated, null and empty ones, and texts with common grams."""
    from quillgraph.operators import containment

    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abé中") for _ in range(draw.randint(1, 4)))
    texts = [(i, " ".join(word() for _ in range(draw.choice([0, 1, 3, 40])))) for i in range(150)] + [(150, None), (7, "again a b"), (151, "common " * 3000)]
    needles = [(i, t[k : k + draw.randint(1, 14)]) for i, (_, t) in enumerate(texts[:120]) if t for k in (0, len(t) // 2)] + [(500, ""), (501, None), (502, "absent"), (503, "common common"), (3, "ab")]
    a = spark.createDataFrame(needles, "needle_id int, needle string")
    b = spark.createDataFrame(texts, "text_id int, text string").repartition(4)
    want = {(i, j) for i, n in needles for j, t in texts if n and t is not None and n in t}
    assert sorted(map(tuple, containment.contained(a, b).distinct().collect())) == sorted(want)
    both = containment.either_way(a.selectExpr("needle_id AS left_id", "needle AS left"), b.selectExpr("text_id AS right_id", "text AS right"), 3)
    assert {tuple(r) for r in both.collect()} == want | {(i, j) for i, n in needles for j, t in texts if n is not None and t and t in n}
    assert containment.contained(a.limit(0), b).collect() == []


def test_containment_rows_follow_what_is_shared(spark, monkeypatch):
    """Long needles give a row for some 32 characters, texts hardly any for what no needle has; no pair is lost."""
    from quillgraph.operators import containment

    draw = random.Random(6)
    text = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    texts = [(i, text(3000)) for i in range(40)]
    needles = [(i, t[5 : 5 + n]) for i, (_, t) in enumerate(texts[:12]) for n in (15, 16, 31, 32, 63, 64, 127, 128, 2900)] + [(99, text(2000))]
    sizes, kept = {}, containment.materialise
    monkeypatch.setattr(containment, "materialise", lambda df, name: sizes.update({name: (out := kept(df, name)).count()}) or out)
    found = containment.contained(spark.createDataFrame(needles, "needle_id int, needle string"), spark.createDataFrame(texts, "text_id int, text string"))
    assert {tuple(r) for r in found.collect()} == {(i, j) for i, n in needles for j, t in texts if n in t}
    assert sizes["needle-grams"] < sum(len(n) for _, n in needles) / 8 and sizes["text-grams"] < sizes["needle-grams"] * 2


def test_postings_follow_inserts_and_deletes(spark, tmp_path):
    """Scores from the index are those of the texts, after each batch, replacement and delete; only the buckets asked for are read."""
    from quillgraph.operators.postings import Postings

    draw = random.Random(9)
    docs = {i: [draw.choice("abcdefghij") + str(draw.randrange(4)) for _ in range(draw.randint(0, 30))] for i in range(60)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id int, tokens array<string>")
    asked = spark.createDataFrame([(1, ["a1", "b2", "b2", "zz"]), (2, ["c3"])], "query_id int, tokens array<string>")
    index = Postings(spark, str(tmp_path), buckets=16)
    same = lambda now: {(r.query_id, r.doc_id): round(r.score, 9) for r in index.scores(asked).collect()} == {(r.query_id, r.doc_id): round(r.score, 9) for r in fusion.bm25(frame(now), asked).collect()}
    index.add(frame({i: t for i, t in docs.items() if i < 40}))
    index.add(frame({i: t for i, t in docs.items() if i >= 40}))
    assert same(docs)
    docs |= {3: ["a1"] * 5, 50: ["c3", "b2"]}
    index.add(frame({i: docs[i] for i in (3, 50)}))
    index.remove(frame({i: docs.pop(i) for i in range(10, 30)}).select("doc_id"))
    assert same(docs)
    plan = index.scores(asked)._jdf.queryExecution().toString()
    assert any(part.lstrip("[").split("]")[0].find("bucket") >= 0 for part in plan.split("PartitionFilters: ")[1:])


def test_metrics(spark, tmp_path):
    """Errors, cache lookups, buckets and the batches of a stream."""
    from quillgraph.session import materialise
    from quillgraph.streaming import metrics

    m = metrics.Metrics()
    run = lambda df: materialise(df, "m")
    m.cached(spark.createDataFrame([(1, "a"), (2, None), (3, None)], "query_id int, hit string"), run, "hybrid")
    texts = spark.createDataFrame([("x",), ("yy",)], "text string")
    out = m.called(texts, "n", metrics.timed_udf(lambda t: t.str.len(), "int"), F.col("text"), "llm", run, "p")
    assert {tuple(r) for r in out.collect()} == {("x", 1), ("yy", 2)}

    def broken(t):
        raise RuntimeError("no answer")

    for call in (lambda: m.called(texts, "n", metrics.timed_udf(broken, "int"), F.col("text"), "embedding", run), lambda: m.count("unknown")):
        try:
            call()
            raise AssertionError
        except AssertionError:
            raise
        except Exception:
            pass
    try:
        with m.timed("graph", "read"):
            raise OSError
    except OSError:
        pass
    for s in (0.004, 0.02, 3.0, 99.0):
        m.observe("aquery_duration_seconds", s)
    rows = {(r.name, r.kind, r.label, r.le): r.value for r in m.rows(spark).collect()}
    assert rows["cache_hits_total", "counter", "hybrid", None] == 1 and rows["cache_misses_total", "counter", "hybrid", None] == 2
    assert rows["llm_calls_total", "counter", "p", None] == 2 and rows["embedding_errors_total", "counter", "default", None] == 1 == rows["graph_errors_total", "counter", "read", None]
    assert [rows["aquery_duration_seconds", "bucket", "", b] for b in (0.005, 0.01, 0.025, 2.5, 5.0, 10.0, None)] == [1, 1, 2, 2, 3, 3, 4]
    spark.streams.addListener(seen := m.listener())
    texts.write.parquet(str(tmp_path / "in"))
    S.ingest_stream(spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in")), open_store(spark, tmp_path), "docs", str(tmp_path / "c")).awaitTermination()
    for _ in range(50):
        if m.counters["aquery_total", ""]:
            break
        time.sleep(0.2)
    spark.streams.removeListener(seen)
    assert m.counters["aquery_total", ""] >= 1 and m.histograms["aquery_duration_seconds", ""][-2] >= 5


def open_store(spark, folder):
    from quillgraph.sources.tables import DeltaStore

    return DeltaStore(spark, str(folder / "kg"))


def test_rate_limit_of_a_hot_key(spark):
    """Batches of a key's rows carry the window on."""
    rows = spark.range(60_000).selectExpr("if(id % 100 = 0, concat('k', id % 7), 'hot') AS key", "CAST(id DIV 3 AS double) AS ts", "id")
    got = {}
    for r in S.rate_limit(rows.repartition(6), 4, 9.0).orderBy("ts", "id").collect():
        got.setdefault(r.key, []).append((r.ts, r.allowed))
    assert sum(map(len, got.values())) == 60_000 and len(got) == 8
    assert all(S.admitted([t for t, _ in v], 4, 9.0)[0] == [a for _, a in v] for v in got.values())


def test_rate_limit_stream_forgets(spark, tmp_path):
    """Keys that are silent for longer than the window leave no state."""
    schema = "key string, ts double, id long"
    for k, rows in enumerate([[(f"k{i}", float(i % 5), i) for i in range(20)], [("late", 1000.0, 100)], [("last", 5000.0, 101)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = S.rate_limit_stream(stream).writeStream.format("memory").queryName("forgets").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("forgets").count() == 22 and q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("A & <b>", "t", "a \"quoted\" line\nand another", "s1"), ("é中", None, "", None)], "id string, entity_type string, description string, source_id string").repartition(2)
    edges = spark.createDataFrame([("A & <b>", "é中", 1.5, "d", None, "s"), ("é中", "é中", None, None, "k1, k2", None)], "source string, target string, weight double, description string, keywords string, source_id string")
    files.write_graphml(nodes, edges, str(tmp_path / "g"))
    back = files.read_graphml(spark, str(tmp_path / "g"))
    empty = lambda r: tuple(x or None for x in r)
    assert sorted(map(str, map(empty, back[0].collect()))) == sorted(map(str, map(empty, nodes.collect())))
    assert sorted(map(str, map(empty, back[1].collect()))) == sorted(map(str, map(empty, edges.collect())))


def test_similar_patients_among_equal_ones(spark, tmp_path):
    """Three others each, also where more than three are equal to the patient and have smaller ids; distances as the SQL adds them up."""
    from quillgraph.plans import registry

    rows = [(1560 * i, 100.25, "x") for i in range(7)] + [(1560 * 9 + i, 90.1 + i / 7, "x") for i in range(1, 40)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = registry.QUERIES["similar_patients"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.sql(registry.ORACLES["similar_patients"]).fetchall()
    assert sorted((r.query_id, r.id, r.distance) for r in got) == sorted(want)
    assert all(sum(r.query_id == q for r in got) == 3 for q in {r.query_id for r in got})


def test_nearest_in_boxes(spark, monkeypatch):
    """Many queries by units: the rows of the plain search, with equal vectors, ties between boxes and vectors without a number, and not by meeting every block."""
    from quillgraph.operators import vector

    draw = np.random.default_rng(3)
    rows = [(i, [float(draw.integers(6)), float(draw.integers(2)), float(draw.choice([0.5, draw.normal() * 3, 7.0]))]) for i in range(1500)]
    rows += [(1500 + i, [1.0, 0.0, 0.1]) for i in range(200)] + [(1800, [1.0, float("nan"), 0.0]), (1801, [0.0, 0.0, -0.0])]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    asked = corpus.filter("id % 3 = 0").withColumnRenamed("id", "query_id")
    for own in (True, False):
        found = []
        for block, box in ((10**6, 4096), (50, 64), (50, 4096)):
            monkeypatch.setattr(vector, "QUERY_BLOCK", block)
            monkeypatch.setattr(vector, "BOX", box)
            found.append(sorted(tuple(r) for r in vector.nearest(asked, corpus, 4, "manhattan", exclude_self=own, units=(10.0, 1.0, 0.3)).collect()))
        assert found[0] == found[1] == found[2] and len(found[0]) == 4 * (asked.count() - 1)
    boxes = vector._Boxes(np.array([v for _, v in rows[:1500]]), (10.0, 1.0, 0.3), 5)
    row, _ = boxes.within(np.array([v for _, v in rows[:300]]), np.full(300, 0.05))
    assert len(row) < 300 * 6


def test_mean_pooling_keeps_the_sign_of_zero(spark, tmp_path):
    from quillgraph.plans import registry

    rows = [(1, [-2e-6] * 32 + [2e-6] * 32, 0), (2, [-0.25] * 64, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["mean_pooling"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(registry.ORACLES["mean_pooling"]).fetchall()
    assert sorted((r.id, repr(list(r.vector))) for r in got) == sorted((i, repr(list(v))) for i, v in want)


def test_large_groups_are_compared_by_blocks(spark, monkeypatch):
    """Pairs of large groups come from one comparison of all vectors in parts, the same pairs as by joins; groups that share no hyperedge stay apart."""
    r = np.random.default_rng(6)
    rows = [(f"e{i}", r.normal(size=6).tolist()) for i in range(60)]
    vectors = spark.createDataFrame(rows, "entity string, vector array<double>")
    inc = spark.createDataFrame([(int(h) + (100 if i >= 50 else 0), f"e{i}") for i in range(60) for h in r.choice(12, 2, replace=False)], "hyperedge long, entity string")
    found, joined = [], ingest._alike
    for cheaper in (0, 10**9):
        calls = []
        monkeypatch.setattr(ingest, "_alike", lambda *a: calls.append(1) or joined(*a))
        monkeypatch.setattr(ingest, "CHEAPER", cheaper)
        monkeypatch.setattr(ingest, "PART", 16)
        found.append({tuple(x) for x in ingest.similar_pairs(inc, vectors, 0.4).collect()})
        assert (len(calls) > 1) == (cheaper == 0)  # members of one hyperedge are joined in either case
    assert found[0] == found[1] and len(found[0]) > 50
    assert not any((int(a[1:]) >= 50) != (int(b[1:]) >= 50) for a, b in found[0])


def test_shares_of_prices_round_as_sql(spark, tmp_path):
    """Prices whose share of 500,000 is a tie of the fourth decimal fall as DuckDB's rounding lets them."""
    from quillgraph.plans import bindings

    con = duckdb.connect()
    con.sql(f"COPY (SELECT i AS o_orderkey, (100025 + 50 * i)::DOUBLE AS o_totalprice, 'F' AS o_orderstatus FROM range(8000) r(i)) TO '{tmp_path}/orders.parquet'")
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    for rows, sql in ((bindings.scorer_output(spark, str(tmp_path)), bindings.SCORED), (bindings.hyperedge_scores(spark, str(tmp_path)), bindings.SCORES)):
        assert sorted(map(tuple, rows.collect())) == sorted(con.sql(sql).fetchall())


def test_contained_shuffles_only_texts_that_meet(spark):
    from quillgraph.operators import containment

    texts = spark.range(5000).selectExpr("id AS text_id", "concat('some text ', id) AS text")
    pairs = spark.createDataFrame([(1, 3), (1, 44), (2, 44)], "needle_id long, text_id long")
    found = {r.text_id: r.text for r in containment._met(texts, pairs).collect()}
    assert found[3] == "some text 3" and found[44] == "some text 44" and len(found) < 100
    needles = spark.createDataFrame([(1, "text 44")], "needle_id long, needle string")
    assert containment.contained(needles, texts).count() == 111


def test_postings_of_odd_token_lists(spark, tmp_path):
    from quillgraph.operators.postings import Postings

    rows = [(1, ["a", "b", "a"]), (2, None), (3, []), (4, ["b", None, None]), (5, ["c"])]
    index = Postings(spark, str(tmp_path / "index"), 4)
    index.add(spark.createDataFrame(rows, "doc_id long, tokens array<string>").coalesce(1))
    got = {(r.doc_id, r.term): r.tf for r in index._postings("long").collect()}
    assert got == {(1, "a"): 2, (1, "b"): 1, (4, "b"): 1, (4, None): 2, (5, "c"): 1}
