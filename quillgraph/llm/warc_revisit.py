"""WARC: resolution of not-modified revisits by an as-of join.

A revisit record says that a page had not changed. It is joined to the latest
earlier full response of its canonical URL; the validators that it names
(ETag, Last-Modified, payload digest) must be those of that response, and its
headers replace those of the response where a 304 may update them.

The as-of join is cut by time as well as by URL: records of a URL within one
of the time ranges (quantiles of all times) are a window of their own, and the
last response of each range is carried over to the later ones. So a URL that a
third of all records have is spread over all ranges; payloads join at the end.

Defined results: ties in time are ordered by record_id, then by a hash of the
record. A null URL or time is never resolved (outcome no_response). A revisit
without validators resolves as ``unvalidated``. Null headers are empty.
Record ids only name records: each revisit is resolved by its own URL, also
where ids are repeated or null, and refers_to is null for a response without
one. Very long payloads are passed on whole. Other columns, and records of
other types, are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import bound_batches, partitions, written

# Headers that a 304 response may update.
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


#: Revisits that share a copy of their response, and parts of a URL's first revisits of a time range.
SPREAD, SALTS = 512, 8


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, sorted query, a path of / where there is none."""
    bare = F.regexp_replace(url, "#.*$", "")
    front = F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    rest = F.substr(bare, F.length(front) + 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(front), "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")
    path = F.regexp_extract(rest, "^([^?]*)", 1)
    query = F.array_join(F.array_sort(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _header(headers: str, name: str) -> Column:
    return F.regexp_replace(F.try_element_at(headers, F.lit(name)), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """Each revisit of records(record_id, type, url, ts, headers, digest, payload) with what it stands for.

    type: response or revisit; ts: a number or time; headers: map by lower-case
    name. Gives record_id, url_key, outcome (resolved, unvalidated, mismatch,
    no_response), refers_to, headers (merged) and payload; the last three are
    null where nothing was resolved.
    """
    spark = records.sparkSession
    empty = F.create_map().cast("map<string,string>")
    rows = records.select("record_id", "type", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("double").alias("ts"), F.coalesce("headers", empty).alias("headers"), "digest", "payload")
    # tells responses apart that share time and record_id
    rows = rows.withColumn("_h", F.xxhash64("url_key", F.to_json("headers"), "digest", "payload"))
    n = partitions(spark)
    cuts = sorted(set(rows.agg(F.percentile_approx("ts", [i / n for i in range(1, n)] or [0.5], 10_000).alias("c")).first()["c"] or []))
    span = F.expr(f"size(filter(array({', '.join(f'{c!r}D' for c in cuts)}), c -> c < ts))") if cuts else F.lit(0)
    revisit = F.col("type") == "revisit"
    own = F.when(F.col("type") == "response", F.struct("ts", "record_id", "_h"))
    # revisits carry what they are checked by and need no join to find it again
    light = rows.filter("type IN ('response', 'revisit')").select("record_id", "type", "url_key", "ts", F.when(revisit, F.col("headers")).alias("headers"), F.when(revisit, F.col("digest")).alias("digest"), "_h", own.alias("_own"), span.alias("span"))
    dated = light.filter("url_key IS NOT NULL AND ts IS NOT NULL")
    within = Window.partitionBy("url_key", "span").orderBy("ts", "record_id", "_h").rowsBetween(Window.unboundedPreceding, -1)
    near = dated.withColumn("_in", F.last("_own", ignorenulls=True).over(within)).filter("type = 'revisit'")
    ends = dated.filter("type = 'response'").groupBy("url_key", "span").agg(F.max("_own").alias("_last"))
    spans = ends.unionByName(near.filter("_in IS NULL").select("url_key", "span", F.lit(None).cast(ends.schema["_last"].dataType).alias("_last"))).groupBy("url_key", "span").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).select("url_key", "span", "_carry")
    asked = ["record_id", "url_key", "headers", "digest", "_h"]
    # a URL's spans are no more than the ranges: salted, so that the revisits of a hot one are spread
    salt = F.pmod(F.col("_h"), F.lit(SALTS)).cast("int")
    first = near.filter("_in IS NULL").withColumn("_s", salt).join(carried.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s")), ["url_key", "span", "_s"], "left")
    found = near.filter("_in IS NOT NULL").select(*asked, F.col("_in").alias("_ref")).unionByName(first.select(*asked, F.col("_carry").alias("_ref")))
    lost = light.filter("type = 'revisit' AND (url_key IS NULL OR ts IS NULL)").select(*asked)
    lost = found.filter("_ref IS NULL").drop("_ref").unionByName(lost)

    # a response is repeated once for every SPREAD revisits that refer to it, and they are dealt to its repeats
    met = written(found.filter("_ref IS NOT NULL").select(*asked[:4], F.col("_h").alias("_r"), F.col("_ref.ts").alias("_t"), F.col("_ref.record_id").alias("_id"), F.col("_ref._h").alias("_h")), "warc-met")
    key = ["_h", "_t", "_id"]
    # only hot responses have more than one; written, so that Spark knows their size and shuffles no payload for a few
    hot = written(met.groupBy(*key).agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("_parts")).filter("_parts > 1"), "warc-hot")
    full = rows.filter("type = 'response'").select(F.col("_h"), F.col("ts").alias("_t"), F.col("record_id").alias("_id"), F.col("headers").alias("_hs"), F.col("digest").alias("_d"), F.col("payload").alias("_p"))
    same = [F.col("l._h") == F.col("r._h"), F.col("l._t") == F.col("r._t"), F.col("l._id").eqNullSafe(F.col("r._id"))]
    parts, n_parts = hot.alias("r"), F.coalesce("r._parts", F.lit(1))
    full = full.alias("l").join(parts, same, "left").select("l.*", n_parts.alias("_parts"))
    if not full.groupBy(*key).count().filter("count > 1").isEmpty():  # responses that are the same in all that is read
        full = full.groupBy(*key).agg(*[F.first(c).alias(c) for c in ("_hs", "_d", "_p", "_parts")])
    full = full.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = met.alias("l").join(parts, same, "left").select("l.*", F.pmod(F.xxhash64("l._r", "l.record_id"), n_parts).cast("int").alias("_part"))
    both = dealt.alias("l").join(full.alias("r"), [*same, F.col("l._part") == F.col("r._part")], "left").select("l.record_id", "l.url_key", "l.headers", "l.digest", F.col("l._id").alias("_ref"), F.col("r._hs").alias("_h"), "r._d", "r._p")
    none = {c: F.lit(None).cast(both.schema[c].dataType).alias(c) for c in ("_ref", "_h", "_d", "_p")}
    both = both.unionByName(lost.select(*asked[:4], *none.values()))
    checks = [(_header("headers", k), _header("_h", k)) for k in ("etag", "last-modified")] + [(F.col("digest"), F.col("_d"))]
    named = [a.isNotNull() for a, _ in checks]
    wrong = [a.isNotNull() & ~F.coalesce(a == b, F.lit(False)) for a, b in checks]
    outcome = F.when(F.col("_h").isNull(), "no_response").when(wrong[0] | wrong[1] | wrong[2], "mismatch").when(named[0] | named[1] | named[2], "resolved").otherwise("unvalidated")
    fresh = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("_h", lambda k, _: ~F.map_contains_key(fresh, k)), fresh)
    good = F.col("outcome").isin("resolved", "unvalidated")
    out = both.withColumn("outcome", outcome)
    return out.select("record_id", "url_key", "outcome", F.when(good, F.col("_ref")).alias("refers_to"), F.when(good, merged).alias("headers"), F.when(good, F.col("_p")).alias("payload"))


class _Members(io.RawIOBase):
    """The plain bytes of gzip members that follow each other, as far as they are whole."""

    def __init__(self, data: bytes):
        self.data, self.at, self.member, self.held = memoryview(data), 0, None, b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.held:
            piece = self.data[self.at : self.at + (1 << 16)]
            if not len(piece):
                return 0
            self.member = self.member or zlib.decompressobj(31)
            try:
                self.held = self.member.decompress(piece)
            except zlib.error:  # what follows is no member
                self.at = len(self.data)
                return 0
            self.at += len(piece) - len(self.member.unused_data)
            if self.member.eof:
                self.member = None
        n = min(len(out), len(self.held))
        out[:n], self.held = self.held[:n], self.held[n:]
        return n


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or of gzip members, one at a time; a file that is cut off ends with its last whole record."""
    stream = io.BufferedReader(_Members(data), 1 << 16) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while line := stream.readline().strip():
            name, _, value = line.partition(b":")
            head[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
        size = int(head.get("content-length", 0))
        body = stream.read(size)
        if len(body) < size:
            return
        http, _, payload = body.partition(b"\r\n\r\n") if head.get("warc-type") in ("response", "revisit") else (b"", b"", body)
        headers = {k.decode("latin-1").strip().lower(): v.strip().decode("latin-1") for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
        yield {"record_id": head.get("warc-record-id"), "type": head.get("warc-type"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "headers": headers, "digest": head.get("warc-payload-digest"), "payload": payload}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under path, a file a row of a task, some megabytes of records at a time."""
    schema = "record_id string, type string, url string, date string, headers map<string,string>, digest string, payload binary"
    names = ["record_id", "type", "url", "date", "headers", "digest", "payload"]

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                held, size = [], 0
                for record in parse_warc(content):
                    held.append(record)
                    size += len(record["payload"]) + 1000
                    if size > 4 << 20:
                        yield pd.DataFrame(held, columns=names)
                        held, size = [], 0
                yield pd.DataFrame(held, columns=names)

    bound_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, schema).withColumn("ts", F.unix_timestamp(F.to_timestamp("date")))


def page_records(pages: DataFrame) -> DataFrame:
    """``pages`` as a crawl: each page a response, and two revisits by other spellings of its URL, one of every eleven with a stale validator."""
    etag = F.md5(F.coalesce("html", F.lit("")))
    first = pages.select((F.col("page_id") * 3).alias("record_id"), F.lit("response").alias("type"), "url", F.col("page_id").alias("ts"), F.create_map(F.lit("etag"), F.concat(F.lit("W/"), etag), F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.col("page_id").cast("string")).alias("headers"), F.lit(None).cast("string").alias("digest"), F.col("html").alias("payload"))
    again = pages.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("_k"), "page_id", "url", "html")
    tag = F.when(F.col("page_id") % 11 == 3, "stale").otherwise(F.md5(F.coalesce("html", F.lit(""))))
    spelt = F.when(F.col("_k") == 1, F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))).otherwise(F.regexp_replace("url", "^http", "HTTP"))
    more = again.select((F.col("page_id") * 3 + F.col("_k")).alias("record_id"), F.lit("revisit").alias("type"), spelt.alias("url"), (F.col("page_id") + F.col("_k") * 5 - 6).alias("ts"), F.create_map(F.lit("etag"), tag, F.lit("date"), F.lit("later"), F.lit("content-type"), F.lit("none")).alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("payload"))
    return first.unionByName(more)


def op9_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of all ``pages`` resolved."""
    done = resolve(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    return done.select("record_id", "url_key", "outcome", "refers_to", F.try_element_at("headers", F.lit("date")).alias("date"), F.try_element_at("headers", F.lit("content-type")).alias("content_type"), F.length("payload").cast("long").alias("n_chars"))


_BARE = "regexp_replace(url, '#.*$', '')"
_FRONT = f"regexp_extract({_BARE}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)"
_REST = f"substr({_BARE}, length({_FRONT}) + 1)"
_QUERY = f"array_to_string(list_sort(string_split(regexp_extract({_REST}, '\\?(.*)$', 1), '&')), '&')"
_PATH = f"regexp_extract({_REST}, '^([^?]*)', 1)"
_KEY = f"regexp_replace(regexp_replace(lower({_FRONT}), '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1') || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END"
ORACLE_SQL = f"""
    WITH resp AS (SELECT page_id * 3 AS id, page_id AS ts, {_KEY} AS k, md5(coalesce(html, '')) AS etag, html FROM pages),
    rev AS (SELECT page_id * 3 + n AS record_id, page_id + n * 5 - 6 AS ts, {_KEY} AS k, CASE WHEN page_id % 11 = 3 THEN 'stale' ELSE md5(coalesce(html, '')) END AS etag FROM pages, (VALUES (1), (2)) AS v(n)),
    j AS (SELECT r.record_id, r.k, r.etag, f.id, f.etag AS fe, f.html FROM rev r LEFT JOIN resp f ON f.k = r.k AND (f.ts < r.ts OR (f.ts = r.ts AND f.id < r.record_id)) QUALIFY row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC, f.id DESC) = 1)
    SELECT record_id, k AS url_key, CASE WHEN id IS NULL THEN 'no_response' WHEN etag <> fe THEN 'mismatch' ELSE 'resolved' END AS outcome, CASE WHEN etag = fe THEN id END AS refers_to,
      CASE WHEN etag = fe THEN 'later' END AS date, CASE WHEN etag = fe THEN 'text/html' END AS content_type, CASE WHEN etag = fe THEN length(html) END AS n_chars FROM j"""
