"""Not-modified revisit resolution: an as-of join of revisit records to the latest earlier full response of their URL.

Records meet by canonical URL. The join is cut twice: first by URL and slice of time, where a running maximum gives each
revisit the latest full response of its own slice; then, over one row for each URL and slice, the latest full response of the
earlier slices is carried forward, for revisits that found none in their own. The slices are cut at quantiles of the times of
all records, so a busy hour is cut as finely as its records ask, and a URL with a third of all records is dealt over a third of
the slices or more. Bodies are never moved: a record refers to its body by id, digest and length.

A response is taken only if a validator agrees: entity tags, compared weakly, if both records have one, else the last
modification times if both have one. The response's headers are then updated with those of the revisit that a not-modified
answer may change, and no others; header names are compared without case and kept as written.

Defined cases: a response of the revisit's own time is not earlier; of responses of one time the largest record id counts;
records without a URL or a time resolve to nothing (`no_earlier`); without comparable validators the outcome is
`no_validator`; repeated revisits are each resolved; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinspark.llm.common import read

#: Headers that a not-modified answer may update, and query parameters that don't name a page.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"^(ref|fbclid|gclid|utm_[a-z]+)(=|$)"
URL = r"^(?i:https?)://([^/?#]*)([^?#]*)\??([^#]*)"


def canonical_url(url: Column) -> Column:
    """Without scheme, default port, fragment, tracking parameters and trailing slashes; lower-case host, sorted parameters. Others than http URLs stay as they are."""
    part = lambda i: F.regexp_extract(F.trim(url), URL, i)
    host = F.regexp_replace(F.lower(part(1)), ":(80|443)$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(part(3), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    whole = F.concat(host, F.regexp_replace(part(2), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(part(1) != "", whole).otherwise(F.nullif(F.trim(url), F.lit("")))


def resolve(records: DataFrame, slices: int = 256) -> DataFrame:
    """records: record_id, url, ts bigint, kind (response or revisit), etag, last_modified, headers map, digest, length.

    Gives one row per revisit: record_id, canon_url, ts, outcome, refers_to, headers, digest, length (the last four null unless resolved).
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canon_url"), "ts", "kind", "etag", "last_modified", "headers", "digest", "length")
    usable = F.col("canon_url").isNotNull() & F.col("ts").isNotNull()
    cuts = rows.filter(usable).agg(F.percentile_approx("ts", [i / slices for i in range(1, slices)] or [0.5], 10_000)).first()[0] or []
    rows = rows.withColumn("slice", F.size(F.filter(F.array(*map(F.lit, sorted({*cuts}))).cast("array<bigint>"), lambda x: x <= F.col("ts"))))
    full = F.struct("ts", "record_id", "etag", "last_modified", F.map_entries("headers").alias("headers"), "digest", "length")
    earlier = Window.partitionBy("canon_url", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    responses = rows.filter(usable & (F.col("kind") == "response"))
    near = rows.filter(usable).withColumn("full", F.when(F.col("kind") == "response", full)).withColumn("full", F.max("full").over(earlier)).filter("kind = 'revisit'")

    last = responses.groupBy("canon_url", "slice").agg(F.max(full).alias("full"))
    asked = near.filter("full IS NULL").select("canon_url", "slice").distinct().withColumn("full", F.lit(None).cast(last.schema["full"].dataType))
    before = Window.partitionBy("canon_url").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    carried = last.union(asked).withColumn("carried", F.max("full").over(before)).filter("full IS NULL").select("canon_url", "slice", "carried")
    found = near.join(carried, ["canon_url", "slice"], "left").withColumn("full", F.coalesce("full", "carried")).drop("carried")
    rest = rows.filter(~usable & (F.col("kind") == "revisit")).withColumn("full", F.lit(None).cast(last.schema["full"].dataType))
    found = found.unionByName(rest)

    strong = lambda c: F.regexp_replace(c, "^W/", "")
    outcome = (
        F.when(F.col("full").isNull(), "no_earlier")
        .when(F.col("etag").isNotNull() & F.col("full.etag").isNotNull(), F.when(strong(F.col("etag")) == strong(F.col("full.etag")), "resolved").otherwise("mismatch"))
        .when(F.col("last_modified").isNotNull() & F.col("full.last_modified").isNotNull(), F.when(F.col("last_modified") == F.col("full.last_modified"), "resolved").otherwise("mismatch"))
        .otherwise("no_validator")
    )
    news = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k).isin(*PERMITTED))
    names = F.transform(F.map_keys("news"), F.lower)
    olds = F.map_filter(F.coalesce(F.map_from_entries("full.headers"), F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(names, F.lower(k)))
    out = found.withColumn("outcome", outcome).withColumn("news", news)
    hit = F.col("outcome") == "resolved"
    cols = [F.when(hit, c).alias(name) for c, name in ((F.col("full.record_id"), "refers_to"), (F.map_concat(olds, "news"), "headers"), (F.col("full.digest"), "digest"), (F.col("full.length"), "length"))]
    return out.select("record_id", "canon_url", "ts", "outcome", *cols)


def records_of(pages: DataFrame) -> DataFrame:
    """The pages table as captures: a full response for each page at time page_id, and a revisit 1000 later.

    The revisit asks with the page's entity tag (a weak one if page_id % 7 = 3, a stale one if page_id % 11 = 5) or, if
    page_id % 5 = 2, with its modification time alone; if page_id % 13 = 6, with neither.
    """
    k, sha = F.col("page_id"), F.sha2(F.coalesce("html", F.lit("")), 256)
    tag = F.concat(F.lit('"'), F.substring("sha", 1, 16), F.lit('"'))
    pages = pages.select("page_id", "url", sha.alias("sha"), F.char_length(F.coalesce("html", F.lit(""))).cast("long").alias("length"))
    headers = lambda *kv: F.map_from_arrays(F.array(*[F.lit(a) for a, _ in kv]), F.array(*[b.cast("string") for _, b in kv]))
    full = pages.select(
        (k * 2).alias("record_id"), "url", k.alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), k.cast("string").alias("last_modified"),
        headers(("content-type", F.lit("text/html")), ("content-length", F.col("length")), ("etag", tag), ("cache-control", F.lit("max-age=60")), ("date", k)).alias("headers"), F.col("sha").alias("digest"), "length",
    )
    asked = F.when((k % 5 == 2) | (k % 13 == 6), None).when(k % 11 == 5, F.lit('"stale"')).when(k % 7 == 3, F.concat(F.lit("W/"), tag)).otherwise(tag)
    revisit = pages.select(
        (k * 2 + 1).alias("record_id"), "url", (k + 1000).alias("ts"), F.lit("revisit").alias("kind"), asked.alias("etag"),
        F.when(k % 13 != 6, k.cast("string")).alias("last_modified"),
        headers(("content-length", F.lit(0)), ("cache-control", F.lit("max-age=600")), ("date", k + 1000), ("set-cookie", F.lit("x=1"))).alias("headers"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("length"),
    )
    return full.union(revisit)


def op4_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(records_of(read(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", "canon_url", "ts", "outcome", "refers_to", lines.alias("headers"), F.col("digest").alias("body_sha256"), F.col("length").alias("body_length"))


OP4_SQL = r"""
WITH p AS (SELECT page_id AS k, trim(url) AS u, sha256(coalesce(html, '')) AS sha, length(coalesce(html, '')) AS n FROM pages),
x AS (SELECT k, sha, n, u, regexp_extract(u, '^(?i:https?)://([^/?#]*)', 1) AS host, regexp_extract(u, '^(?i:https?)://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^(?i:https?)://[^/?#]*[^?#]*\??([^#]*)', 1) AS query FROM p),
y AS (SELECT k, sha, n, '"' || sha[1:16] || '"' AS tag, u, host, path, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda z: z <> '' AND NOT regexp_matches(z, '^(ref|fbclid|gclid|utm_[a-z]+)(=|$)'))), '&') AS q FROM x),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(lower(host), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || CASE WHEN coalesce(q, '') <> '' THEN '?' || q ELSE '' END ELSE nullif(u, '') END AS canon_url FROM y),
r AS (SELECT k, canon_url, k + 1000 AS ts, CASE WHEN k % 5 = 2 OR k % 13 = 6 THEN NULL WHEN k % 11 = 5 THEN '"stale"' ELSE tag END AS etag, CASE WHEN k % 13 <> 6 THEN CAST(k AS VARCHAR) END AS lm FROM c),
j AS (SELECT r.*, f.k AS fk, f.tag AS ftag, f.n AS fn, f.sha AS fsha, row_number() OVER (PARTITION BY r.k ORDER BY f.k DESC) AS no FROM r LEFT JOIN c f ON f.canon_url = r.canon_url AND f.k < r.ts),
o AS (SELECT *, CASE WHEN fk IS NULL THEN 'no_earlier' WHEN etag IS NOT NULL THEN CASE WHEN etag = ftag THEN 'resolved' ELSE 'mismatch' END WHEN lm IS NOT NULL THEN CASE WHEN lm = CAST(fk AS VARCHAR) THEN 'resolved' ELSE 'mismatch' END ELSE 'no_validator' END AS outcome FROM j WHERE no = 1)
SELECT k * 2 + 1 AS record_id, canon_url, ts, outcome, CASE WHEN outcome = 'resolved' THEN fk * 2 END AS refers_to,
       CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || fn || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || ftag END AS headers,
       CASE WHEN outcome = 'resolved' THEN fsha END AS body_sha256, CASE WHEN outcome = 'resolved' THEN fn END AS body_length FROM o
"""
