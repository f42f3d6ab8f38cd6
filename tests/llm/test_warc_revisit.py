import gzip

import duckdb

from quillgraph.llm import warc_revisit as W


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    got = W.op9_warc_revisit(spark, d)
    assert sorted(map(str, con.sql(W.ORACLE_SQL).fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def test_cases(spark):
    rows = [
        (1, "response", "http://A.com:80/x?b=2&a=1#f", 10, {"etag": 'W/"e1"', "date": "d1", "server": "s"}, "sha1", "one"),
        (2, "revisit", "http://a.com/x?a=1&b=2", 20, {"etag": '"e1"', "date": "d2", "server": "t"}, None, None),
        (3, "response", "http://a.com/x?a=1&b=2", 30, {"etag": '"e2"'}, "sha2", "two"),
        (4, "revisit", "http://a.com/x?a=1&b=2", 30, {"etag": '"e1"'}, None, None),
        (5, "revisit", "http://a.com/x?a=1&b=2", 99, None, "sha2", None),
        (6, "revisit", "http://a.com/x?a=1&b=2", 5, {"etag": '"e1"'}, None, None),
        (7, "revisit", None, 50, None, None, None),
        (8, "revisit", "http://a.com/x?a=1&b=2", 98, {}, None, None),
        (9, "revisit", "http://a.com/x?a=1&b=2", None, {}, None, None),
    ]
    rows += [(100 + i, "revisit", "http://hot.com", 100 + i, {}, None, None) for i in range(50)] + [(90, "response", "HTTP://hot.com/", 90, {"a": "b"}, None, "x" * 10**6)]
    recs = spark.createDataFrame(rows, "record_id long, type string, url string, ts long, headers map<string,string>, digest string, payload string").withColumn("outcome", W.F.lit("clash"))
    got = {r.record_id: r for r in W.resolve(recs).collect()}
    assert len(got) == 57
    assert got[2].outcome == "resolved" and got[2].refers_to == 1 and got[2].headers == {"etag": '"e1"', "date": "d2", "server": "s"} and got[2].payload == "one"
    assert got[4].outcome == "mismatch" and got[4].payload is None
    assert (got[5].outcome, got[5].refers_to) == ("resolved", 3)
    assert got[6].outcome == got[7].outcome == got[9].outcome == "no_response"
    assert (got[8].outcome, got[8].payload) == ("unvalidated", "two")
    assert all(got[100 + i].refers_to == 90 for i in range(50))
    assert W.resolve(recs.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [
        (1, "response", "http://a/", 1, {"etag": "x"}, None, "of a"),
        (1, "response", "http://b/", 1, {"etag": "y"}, None, "of b"),
        (7, "revisit", "http://a/", 5, {"etag": "x"}, None, None),
        (7, "revisit", "http://b/", 5, {"etag": "y"}, None, None),
        (None, "revisit", "http://b/", 6, {"etag": "y"}, None, None),
        (None, "response", "http://c/", 1, {"etag": "z"}, None, "of c"),
        (8, "revisit", "http://c/", 2, {"etag": "z"}, None, None),
        (8, "revisit", "http://c/", 2, {"etag": "z"}, None, None),
        (9, "metadata", "http://c/", 2, {}, None, None),
    ]
    got = W.resolve(spark.createDataFrame(rows, "record_id long, type string, url string, ts long, headers map<string,string>, digest string, payload string")).collect()
    assert sorted((str(r.record_id), r.url_key, r.outcome, str(r.refers_to), r.payload) for r in got) == sorted(
        [("7", "http://a/", "resolved", "1", "of a"), ("7", "http://b/", "resolved", "1", "of b"), ("None", "http://b/", "resolved", "1", "of b"), *[("8", "http://c/", "resolved", "None", "of c")] * 2]
    )


def test_hot_response(spark):
    """More revisits of one response than share a copy, before and after the ranges' ends."""
    rows = [(0, "response", "http://h/", 0, {"etag": "e"}, None, "p")] + [(i, "revisit", "http://h/", i, {"etag": "e"}, None, None) for i in range(1, 3 * W.SPREAD)]
    got = W.resolve(spark.createDataFrame(rows, "record_id long, type string, url string, ts long, headers map<string,string>, digest string, payload string")).collect()
    assert sorted(r.record_id for r in got) == list(range(1, 3 * W.SPREAD)) and all(r.payload == "p" and r.refers_to == 0 for r in got)


def test_cut_off_files():
    whole = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [r["payload"] for r in W.parse_warc(whole * 2 + whole[:-6])] == [b"abc"] * 2
    packed = gzip.compress(whole)
    assert [r["payload"] for r in W.parse_warc(packed * 3 + packed[:-9])][:3] == [b"abc"] * 3
    assert list(W.parse_warc(b"")) == []


def test_reads_files(spark, tmp_path):
    def record(kind, ident, http):
        body = http.encode()
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {ident}\r\nWARC-Target-URI: http://a.com/\r\nWARC-Date: 2024-01-0{ident}T00:00:00Z\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    parts = [record("response", "1", "HTTP/1.1 200 OK\r\nETag: x\r\n\r\n<html>é"), record("revisit", "2", "HTTP/1.1 304 Not Modified\r\nETag: x\r\n\r\n")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    got = W.resolve(W.read_warc(spark, str(tmp_path))).collect()
    assert [(r.record_id, r.refers_to, bytes(r.payload).decode()) for r in got] == [("2", "1", "<html>é")]
