"""WARC not-modified revisits: as-of join by canonical URL to the latest earlier full response.

Captures are range-partitioned by (canonical URL, time), so a URL with a third of all captures is
cut over many tasks; each task runs along its sorted rows and carries the last full response, and
what a range hands on to the next is taken from a table with at most two rows for each partition.
A revisit resolves if its validators match the response: entity tags (weak comparison) if both have
one, else Last-Modified if both have it, else payload digests. Header fields of the revisit that a
304 may update replace those of the stored response; the others stay as stored.

Defined results: a response's outcome is `full`; a revisit's is `resolved`, `mismatch`,
`no_validator` or `no_earlier`; equal times aren't earlier, and of responses at one time the
greatest record_id counts; rows without record_id have no result; without URL or time they have
outcome `no_earlier`; null headers are none; header names are lower-cased, and of names that differ in
case only the last in order of code points counts; values of any length are kept whole; repeated
rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, let, shuffle_partitions, table

# Header fields of a stored response that a 304 may not replace.
FIXED_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Without scheme, www, default port, fragment, tracking parameters, a page suffix and a last slash; host in lower case, parameters in order."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place, query = F.regexp_extract(bare, "^([^?]*)", 1), F.regexp_extract(bare, "\\?(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(place, "^([^/]*)", 1)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(place, "^[^/]*(.*)$", 1), "/index\\.html?$", "/"), "/+$", "")
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid)(=|$)") & (p != ""))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def merged_headers(stored: Column, update: Column) -> Column:
    allowed = F.map_filter(update, lambda k, v: ~k.isin(*FIXED_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def lower_names(headers: Column) -> Column:
    """Header fields by lower-case name; of names that differ in case only, the last in order of code points counts."""
    fields = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["key"].alias("as_sent"), e["value"].alias("value"))))
    last = lambda f: F.filter(f, lambda e, i: F.coalesce(F.get(f, i + 1)["name"] != e["name"], F.lit(True)))
    return F.map_from_entries(F.transform(let(fields, last), lambda e: F.struct(e["name"], e["value"])))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(captures: DataFrame, scratch: Scratch) -> DataFrame:
    """captures: record_id, url, ts (long), kind (response, revisit), etag, last_modified, digest, headers (map).

    Returns record_id, canonical_url, outcome, base_id, headers: those of the response, merged for resolved revisits.
    """
    empty = F.create_map().cast("map<string,string>")
    rows = captures.where("record_id IS NOT NULL").select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", "etag", "last_modified", "digest", F.coalesce(lower_names(F.col("headers")), empty).alias("headers"))
    dealt = scratch.save(rows.repartitionByRange(shuffle_partitions(captures.sparkSession), "canonical_url", "ts").withColumn("part", F.spark_partition_id()), "captures")
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "digest", F.to_json("headers").alias("headers")))
    # A capture's earlier ones are those of a lower time, so a frame over time, not over rows.
    earlier = Window.partitionBy("part", "canonical_url").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.max(full).over(earlier))

    ends = dealt.where("canonical_url IS NOT NULL").groupBy("part").agg(F.min("canonical_url").alias("low"), F.max("canonical_url").alias("high")).select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("canonical_url"))
    runs = dealt.join(F.broadcast(ends), ["part", "canonical_url"]).groupBy("part", "canonical_url").agg(F.max(full).alias("last"))
    before = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select("part", "canonical_url", F.max("last").over(before).alias("carried")).where("carried IS NOT NULL")

    out = near.join(F.broadcast(carried), ["part", "canonical_url"], "left").withColumn("base", F.coalesce("near", "carried"))
    b = F.col("base")
    both = lambda c: F.col(c).isNotNull() & b[c].isNotNull()
    match = F.when(both("etag"), _strong(F.col("etag")) == _strong(b["etag"])).when(both("last_modified"), F.col("last_modified") == b["last_modified"]).when(both("digest"), F.col("digest") == b["digest"])
    usable = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull() & b.isNotNull()
    outcome = F.when(F.col("kind") == "response", "full").when(~usable, "no_earlier").when(match.isNull(), "no_validator").when(match, "resolved").otherwise("mismatch")
    out = out.withColumn("outcome", outcome)
    stored = F.from_json(b["headers"], "map<string,string>")
    resolved = F.col("outcome") == "resolved"
    return out.select("record_id", "canonical_url", "outcome", F.when(resolved, b["record_id"]).alias("base_id"), F.when(resolved, merged_headers(stored, F.col("headers"))).otherwise(F.col("headers")).alias("headers"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Two captures of each page: its full response, and a later not-modified answer under another spelling of the URL.

    The tables hold no captures, so times and headers follow from page_id by fixed rules; every
    fifth page's tag no longer matches, and every seventh has no tag but a date.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    date = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    p = pages.where("page_id IS NOT NULL").withColumn("tag", F.when(F.col("page_id") % 7 != 0, tag)).withColumn("date", date).withColumn("digest", F.sha1("html"))
    full = p.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit("response").alias("kind"), F.col("tag").alias("etag"), F.col("date").alias("last_modified"), "digest",
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length("html").cast("string"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
    )
    again = p.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"), (F.col("page_id") * 10 + 25).alias("ts"), F.lit("revisit").alias("kind"),
        F.when(F.col("page_id") % 5 == 0, F.lit('"old"')).otherwise(F.concat(F.lit("W/"), F.col("tag"))).alias("etag"), F.col("date").alias("last_modified"), "digest",
        F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.concat(F.lit("max-age="), F.col("page_id").cast("string"))).alias("headers"),
    )
    return full.unionByName(again)


def op2_warc_revisits(spark, sf_dir) -> DataFrame:
    out = resolve_revisits(page_captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")), Scratch(spark, "warc"))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return out.select("record_id", "canonical_url", "outcome", "base_id", F.array_join(lines, "; ").alias("headers"))


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN page_id % 7 <> 0 THEN '"' || substr(md5(html), 1, 16) || '"' END AS tag,
    'day ' || (page_id % 28) AS date, sha1(html) AS digest, length(html) AS len FROM pages),
c AS (
  SELECT page_id * 2 AS record_id, url, page_id * 10 AS ts, 'response' AS kind, tag AS etag, date, digest,
    'text/html' AS ctype, len::VARCHAR AS clen, 'max-age=60' AS cache FROM p
  UNION ALL
  SELECT page_id * 2 + 1, regexp_replace(url, '#.*$', '') || '#again', page_id * 10 + 25, 'revisit',
    CASE WHEN page_id % 5 = 0 THEN '"old"' ELSE 'W/' || tag END, date, digest, NULL, '0', 'max-age=' || page_id FROM p),
b AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM c),
s AS (SELECT *, regexp_extract(bare, '^([^?]*)', 1) AS place, regexp_extract(bare, '\?(.*)$', 1) AS query FROM b),
u AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(place, '^([^/]*)', 1)), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_replace(regexp_extract(place, '^[^/]*(.*)$', 1), '/index\.html?$', '/'), '/+$', '') AS head,
    array_to_string(list_sort(list_filter(string_split(query, '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') AS kept FROM s),
k AS (SELECT *, head || CASE WHEN coalesce(kept, '') <> '' THEN '?' || kept ELSE '' END AS canonical_url FROM u),
r AS (
  SELECT v.record_id, max(f.ts * 1000000000000 + f.record_id) AS top FROM k v JOIN k f
    ON v.kind = 'revisit' AND f.kind = 'response' AND v.canonical_url = f.canonical_url AND f.ts < v.ts GROUP BY 1),
j AS (
  SELECT k.*, f.record_id AS fid, f.ctype AS ftype, f.clen AS flen,
    CASE WHEN k.kind = 'response' THEN 'full' WHEN f.record_id IS NULL THEN 'no_earlier'
      WHEN (CASE WHEN k.etag IS NOT NULL AND f.etag IS NOT NULL THEN regexp_replace(k.etag, '^W/', '') = regexp_replace(f.etag, '^W/', '')
                 ELSE k.date = f.date END) THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM k LEFT JOIN r USING (record_id) LEFT JOIN k f ON f.kind = 'response' AND f.record_id = r.top % 1000000000000)
SELECT record_id, canonical_url, outcome, CASE WHEN outcome = 'resolved' THEN fid END AS base_id,
  'cache-control: ' || cache || '; content-length: ' || CASE WHEN outcome = 'resolved' THEN flen ELSE clen END
    || CASE WHEN outcome = 'resolved' THEN '; content-type: ' || ftype WHEN ctype IS NOT NULL THEN '; content-type: ' || ctype ELSE '' END AS headers
FROM j
"""
