import re
from collections import Counter

import corpus_pipeline as C
import pytest
import test_jaccard_join
import test_quality_rules
import test_source_mix
import test_suffix_dedup

tiktoken = pytest.importorskip("tiktoken")
import public_tokenizers as P  # noqa: E402

from quillgraph.llm import byte_bpe  # noqa: E402


def test_stages_against_brute_force(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").unionByName(spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    columns = docs.columns
    for k, (name, stage) in enumerate(C.STAGES):
        rows = docs.collect()
        stage(spark, docs, d).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        got = docs.collect()
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            kept = test_quality_rules.brute([(r.doc_id, r.text, r.lang) for r in rows])
            assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r, x in zip(rows, kept, strict=True) if x[-1])
        elif k == 1:
            group = test_jaccard_join.brute([(r.doc_id, r.text) for r in rows])
            assert sorted(r.doc_id for r in got) == sorted(i for i, c in group.items() if i == c)
        elif k == 2:
            want = {i: b.decode("utf-8", "ignore") for i, _, _, _, b in test_suffix_dedup.brute([(r.doc_id, r.text) for r in rows])}
            assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
        elif k == 3:
            size = Counter()
            for r in rows:
                size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
            taken = Counter()
            for r in got:
                taken[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
            assert max(Counter(r.doc_id for r in got).values()) <= 3
            longest = max(len(r.text.split()) for r in rows)
            assert all(abs(taken[s] - t) <= longest for s, t in test_source_mix.brute_targets(dict(size)).items())
        else:
            own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
            want = Counter((r.doc_id, b"".join(x.to_bytes(4, "little") for x in own.encode_ordinary(r.text))) for r in rows)
            assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    assert got


def test_run_and_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
