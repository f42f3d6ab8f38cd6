import hashlib

import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from quillgraph.llm import byte_bpe as B  # noqa: E402

TEXTS = ["", None, "Hello world", "aaaaaaa aaaa aaa", "élan vital — 東京 🙂🙂", "  lead\n\n trail \t x", "tokenization's re-unified 12345", "\x00\x01 ###*** ABC!!" * 50, "the of and " * 3000, "x" * 5000, "<|endoftext|> as text"]


@pytest.fixture(scope="module")
def ranks():
    return B.load_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_library_and_round_trip(spark, ranks, reference):
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)] + [(2, "Hello world", None)], "doc_id long, text string, ids string")
    rows = B.decode(B.encode(docs, ranks, P.PATTERN), ranks).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        want = reference.encode_ordinary(r.text or "")
        assert r.n_tokens == len(want)
        assert bytes(r.ids) == b"".join(x.to_bytes(4, "little") for x in want)
        assert bytes(r.decoded) == (r.text or "").encode()


def test_empty_table(spark, ranks):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert B.decode(B.encode(docs, ranks, P.PATTERN), ranks).count() == 0


def test_join_that_ranks_below_its_parts():
    ranks = {bytes([b]): 100 + b for b in range(256)} | {b"bc": 2, b"ab": 5, b"abc": 1, b"abca": 0, b"ca": 3}
    merges = B.Merges(ranks)
    own = tiktoken.Encoding("odd", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    words = ["abcabcab", "ababab", "cabcaabc", "bcabca", "abcaabca", "abab" * 9 + "c"]
    for w, ids in zip(words, merges.replay([w.encode() for w in words]), strict=True):
        assert ids.tolist() == own.encode_ordinary(w), w


def test_query(spark, reference):
    rows = {r.doc_id: r for r in B.op10_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = reference.encode_ordinary(d.text)
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()
