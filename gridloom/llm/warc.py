"""Web archive records: reading, and resolving not-modified revisits.

A revisit record says that a page had not changed; its body is that of the
latest earlier full response for the same canonical URL.  The as-of join runs
in levels so that a URL with a third of all records is no single task, be they
spread over years or in one burst: time is cut into spans of FAN microseconds,
each (URL, span) is searched by itself, and the last responses of the spans, one
row for each, are carried forward in the same way, FAN spans together.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, joinable, tidy

#: Query parameters that do not tell pages apart.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref|sessionid|phpsessid)(=|$)"
#: Headers of a not-modified answer that never replace those of the stored response.
NOT_MERGED = ["connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade", "content-length", "content-encoding", "content-type", "content-range", "content-md5"]
#: At most so many times of one URL, or spans of times, are put in order together.
FAN = 100_000
#: Bytes of records that the reader hands on at a time, about.
READ_BYTES = 16 << 20

RECORD = "record_id string, url string, ts timestamp, type string, headers map<string,string>, body binary"


def canonical_url(url: Column) -> Column:
    """Host without case, www. and default port, path without final slash, sorted query without tracking; no scheme, no fragment."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1)), "^www[.]|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    query = F.array_join(kept, "&")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def latest_earlier(records: DataFrame) -> DataFrame:
    """(url_key, ts, response_id) of the times at which there are revisits, from (record_id, url_key, ts long, full boolean).

    The response is the one with the greatest (ts, record_id) among those with
    a strictly smaller ts; null where there is none.  Rows with a null URL or
    time are left out.  Records of one URL and time count as one before anything
    is put in order.
    """
    spread = records.agg(F.min("ts"), F.max("ts")).first()
    first, last = (x or 0 for x in spread)
    response = F.when(F.col("full") & F.col("record_id").isNotNull(), F.struct("ts", F.col("record_id").alias("id")))
    times = records.where("url_key is not null and ts is not null").groupBy("url_key", "ts").agg(F.max(response).alias("last"), F.bool_or(~F.col("full")).alias("asks"))
    found = carry(times.withColumn("place", F.col("ts").cast("decimal(20,0)") - F.lit(first)), last - first + 1)
    return found.where("asks").select("url_key", "ts", F.col("far.id").alias("response_id"))


def carry(rows: DataFrame, places: int) -> DataFrame:
    """Adds ``far``, the greatest ``last`` of the URL's smaller places, to rows with url_key, place and last; no URL has a place twice.

    Places go together by FAN, level upon level, so that a URL that has all of
    them is never ordered in one task.
    """
    before = lambda *by: F.max("last").over(Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    if places <= FAN:
        return rows.withColumn("far", before("url_key"))
    rows = checkpoint(rows.withColumn("above", F.expr(f"place div {FAN}")))
    upper = carry(rows.groupBy("url_key", F.col("above").alias("place")).agg(F.max("last").alias("last")), -(-places // FAN))
    upper = upper.select("url_key", F.col("place").alias("above"), F.col("far").alias("farther"))
    near = rows.withColumn("far", before("url_key", "above"))
    return near.join(upper, ["url_key", "above"]).withColumn("far", F.coalesce("far", "farther")).drop("above", "farther")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers, updated by those that a not-modified answer may change."""
    allowed = F.map_filter(fresh, lambda k, _: ~k.isin(NOT_MERGED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def verdict(stored: Column, fresh: Column) -> Column:
    """resolved or stale: entity tags are compared without weakness, else the dates of last change, else payload digests; without a common validator the record is unverified."""
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    for_ = lambda a, b: F.when(a == b, "resolved").otherwise("stale")
    has = lambda name: stored[name].isNotNull() & fresh[name].isNotNull()
    return (
        F.when(has("etag"), for_(tag(stored), tag(fresh)))
        .when(has("last-modified"), for_(stored["last-modified"], fresh["last-modified"]))
        .when(has("warc-payload-digest"), for_(stored["warc-payload-digest"], fresh["warc-payload-digest"]))
        .otherwise("unverified")
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """All revisits of ``records`` (record_id, url, ts, type, headers, body) with what they stand for.

    Gives record_id, url_key, response_id, status (resolved, unverified, stale
    or missing), headers and body; a stale or missing one keeps its own headers
    and has no body.  Header names are in lower case.  Rows with one id are one
    record, the one least by time, URL and hash of its content; a revisit
    without an id is a record of its own, a response without one is never found.
    Null URLs, times and headers are allowed (missing; no headers).  Other
    record types are ignored.  An empty table gives an empty result.
    """
    empty = F.create_map().cast("map<string,string>")
    content = F.xxhash64("url", "ts", F.array_sort(F.map_entries("headers")), "body")
    known = records.where(F.col("type").isin("response", "revisit")).select("*", canonical_url(F.col("url")).alias("url_key"), F.unix_micros("ts").alias("micros"), content.alias("content"))
    order = F.struct("micros", "url_key", "content")
    responses, revisits = known.where("type = 'response' and record_id is not null"), known.where("type = 'revisit'")
    narrow = checkpoint(responses.groupBy("record_id").agg(F.min(order).alias("r"), F.count("*").alias("n")))
    named = revisits.where("record_id is not null").groupBy("record_id").agg(F.min_by(F.struct("url_key", "micros", "headers"), order).alias("r")).select("record_id", "r.*")
    asked = checkpoint(named.union(revisits.where("record_id is null").select("record_id", "url_key", "micros", "headers")))
    times = narrow.select("record_id", "r.url_key", F.col("r.micros").alias("ts"), F.lit(True).alias("full"))
    times = times.union(asked.select("record_id", "url_key", F.col("micros").alias("ts"), F.lit(False)))
    found = asked.join(latest_earlier(times).withColumnRenamed("ts", "micros"), ["url_key", "micros"], "left").select("record_id", "url_key", "response_id", F.coalesce("headers", empty).alias("fresh"))
    columns = [F.col("record_id").alias("response_id"), F.coalesce("headers", empty).alias("stored"), "body"]
    again = joinable(narrow.where("n > 1").select("record_id", F.col("r.content").alias("content")))
    repeated = responses.join(again, ["record_id", "content"], "left_semi").select(columns).dropDuplicates(["response_id"])
    stored = responses.join(again.select("record_id"), "record_id", "left_anti").select(columns).union(repeated)
    joined = found.join(stored, "response_id", "left")
    status = F.when(F.col("response_id").isNull(), "missing").otherwise(verdict(F.col("stored"), F.col("fresh")))
    good = F.col("status").isin("resolved", "unverified")
    return joined.withColumn("status", status).select(
        "record_id", "url_key", "response_id", "status",
        F.when(good, merged_headers(F.col("stored"), F.col("fresh"))).otherwise(F.col("fresh")).alias("headers"),
        F.when(good, F.col("body")).alias("body"),
    )


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of a WARC file's bytes, plain or gzip, HTTP headers taken apart.

    A record without a valid length has no body, and reading goes on at the next
    record's first line.  A file that is cut or damaged gives the records before
    that place, the last one as far as it goes; no bytes give no records.
    """
    stream = io.BufferedReader(_Unpacked(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = _headers(stream)
        length = head.get("content-length", "")
        block = stream.read(min(int(length), len(data) << 10)) if length.isascii() and length.isdigit() else b""
        out = {"record_id": head.get("warc-record-id"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "type": head.get("warc-type"), "headers": {}, "body": block}
        if head.get("content-type", "").startswith("application/http"):
            part = io.BytesIO(block)
            part.readline()
            out["headers"], out["body"] = _headers(part), part.read()
        if "warc-payload-digest" in head:
            out["headers"]["warc-payload-digest"] = head["warc-payload-digest"]
        yield out


class _Unpacked(io.RawIOBase):
    """The content of gzip members one after the other, as far as they are whole."""

    def __init__(self, data: bytes):
        self.data, self.at, self.member, self.ended = memoryview(data), 0, zlib.decompressobj(31), False

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while self.at < len(self.data) or not self.ended:
            self.ended = self.at == len(self.data)
            fed = self.data[self.at : self.at + (1 << 16)]
            try:
                out = self.member.decompress(fed, len(buffer))
            except zlib.error:
                self.at, self.ended = len(self.data), True
                return 0
            self.at += len(fed) - len(self.member.unused_data or self.member.unconsumed_tail)
            if self.member.eof:
                self.member = zlib.decompressobj(31)
            if out:
                self.ended = False  # there may be more of the same input
                buffer[: len(out)] = out
                return len(out)
        return 0


def _headers(stream) -> dict[str, str]:
    out: dict[str, str] = {}
    while line := stream.readline().strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, a file (of up to 2 GB) to a task, handed on as they are parsed.

    Damaged and cut files give what comes before, as ``parse_records`` says;
    a date that is none gives a null time, an empty file no rows.
    """
    schema = "record_id string, url string, date string, type string, headers map<string,string>, body binary"
    kinds = {"record_id": pa.string(), "url": pa.string(), "date": pa.string(), "type": pa.string(), "headers": pa.map_(pa.string(), pa.string()), "body": pa.binary()}

    def packed(rows: list[dict]) -> pa.RecordBatch:
        value = lambda r, k: list(r[k].items()) if k == "headers" else r[k]
        return pa.RecordBatch.from_arrays([pa.array([value(r, k) for r in rows], type=t) for k, t in kinds.items()], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for r in parse_records(data.as_py()):
                    rows.append(r)
                    size += len(r["body"])
                    if size > READ_BYTES:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(tidy(run), schema)
    return rows.select("record_id", "url", F.try_to_timestamp("date").alias("ts"), "type", "headers", "body")


def page_records(pages: DataFrame) -> DataFrame:
    """Archive records made of the pages table: a response for each page and a later or earlier revisit.

    Null pages are empty ones, null URLs stay null; an empty table gives no records.
    Revisits write the URL differently, some carry a weak entity tag, and every
    seventh carries the tag of another version.
    """
    n, html = F.col("page_id"), F.coalesce(F.col("html"), F.lit(""))
    tag = F.concat(F.lit('"'), F.md5(html), F.lit('"'))
    response = F.create_map(*map(F.lit, ("content-type", "text/html")), F.lit("content-length"), F.length(html).cast("string"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("etag"), tag)
    fresh = F.when(n % 7 == 0, '"other"').when(n % 5 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    revisit = F.create_map(*map(F.lit, ("connection", "close", "content-length", "0", "cache-control", "max-age=120")), F.lit("etag"), fresh)
    names = ("k", "url", "s", "type", "headers", "body")
    row = lambda *x: F.struct(*(v.alias(k) for k, v in zip(names, x)))
    again = F.concat(F.replace(F.col("url"), F.lit("https://"), F.lit("HTTP://")), F.lit("#again"))
    full = row(F.lit("a"), F.col("url"), n * 60, F.lit("response"), response, F.encode(html, "UTF-8"))
    short = row(F.lit("b"), again, n * 60 + (n * 7919 % 1000 - 100) * 60, F.lit("revisit"), revisit, F.lit(None).cast("binary"))
    rows = pages.select(n, F.explode(F.array(full, short)).alias("r"))
    return rows.select(F.concat(F.col("page_id").cast("string"), F.col("r.k")).alias("record_id"), "r.url", F.timestamp_seconds(F.col("r.s") + 1_000_000_000).alias("ts"), "r.type", "r.headers", "r.body")


def digest(resolved: DataFrame) -> DataFrame:
    """Plain columns of ``resolve_revisits`` for comparison."""
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    number = lambda c: F.regexp_extract(c, r"^(-?\d+)", 1).cast("long")
    return resolved.select(
        number("record_id").alias("page_id"), "url_key",
        F.when(F.col("response_id").isNotNull(), number("response_id")).alias("response_page_id"),
        "status", F.array_join(lines, "\n").alias("headers"),
        F.octet_length("body").cast("long").alias("n_bytes"), F.md5("body").alias("body_md5"),
    )


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, '"' || md5(coalesce(html, '')) || '"' AS tag, regexp_replace(trim(url), '#.*$', '') AS u FROM pages
), c AS (
  SELECT *, regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)), '^www[.]|:(80|443)$', '', 'g')
    || regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS base,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|ref|sessionid|phpsessid)(=|$)'))), '&') AS query FROM p
), k AS (SELECT page_id, html, tag, base || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url_key FROM c),
v AS (
  SELECT page_id, url_key, page_id * 60 + (page_id * 7919 % 1000 - 100) * 60 AS ts,
    CASE WHEN page_id % 7 = 0 THEN '"other"' WHEN page_id % 5 = 0 THEN 'W/' || tag ELSE tag END AS tag FROM k
), j AS (SELECT v.*, r.page_id AS response_page_id, r.html AS html, r.tag AS stored FROM v ASOF LEFT JOIN (SELECT *, page_id * 60 AS rts FROM k) r ON v.url_key = r.url_key AND v.ts > r.rts),
s AS (SELECT *, CASE WHEN response_page_id IS NULL THEN 'missing' WHEN regexp_replace(tag, '^W/', '') = stored THEN 'resolved' ELSE 'stale' END AS status FROM j)
SELECT page_id, url_key, response_page_id, status,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || length(html) || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || tag
    ELSE 'cache-control: max-age=120' || chr(10) || 'connection: close' || chr(10) || 'content-length: 0' || chr(10) || 'etag: ' || tag END AS headers,
  CASE WHEN status = 'resolved' THEN CAST(strlen(html) AS BIGINT) END AS n_bytes, CASE WHEN status = 'resolved' THEN md5(html) END AS body_md5
FROM s
"""
