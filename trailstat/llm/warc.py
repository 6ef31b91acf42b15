"""Not-modified (revisit) records resolved to the full response that they repeat.

A revisit takes the latest earlier full response of its canonical URL, by an as-of join; validators
must agree, and the headers that a 304 may update replace the stored ones. A URL may hold a third of
all records: records are cut into stretches of time, the last response of each stretch is carried on
to later ones through a table of one row a stretch, and no window spans a URL's whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values (RFC 9110, 15.4.5): headers that a 304 sends for its stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")

HEADERS = "array<struct<name:string,value:string>>"
#: Time units of a stretch.
STRETCH = 10_000


def canonical_url(url: Column) -> Column:
    """Without scheme, leading www. or m., fragment, tracking parameters and closing / ? &; the host in lower case."""
    u = F.regexp_replace(F.regexp_replace(url, "#.*", ""), r"^[A-Za-z]+://(www\.|m\.)?", "")
    host = F.regexp_extract(u, "^[^/?]*", 0)
    rest = F.substring(u, F.length(host) + 1, F.length(u))
    rest = F.regexp_replace(F.regexp_replace(rest, "&(utm_[a-z]+|ref)=[^&]*", ""), r"\?(utm_[a-z]+|ref)=[^&]*&?", "?")
    return F.concat(F.lower(host), F.regexp_replace(rest, "[?&/]+$", ""))


def _strong(etag: str) -> Column:
    return F.regexp_replace(F.col(etag), "^W/", "")


def resolve_revisits(captures: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row per record: record_id, kind, canonical_url, ts, matched_id, outcome, headers.

    ``captures``: record_id long, url, ts long, kind (response or revisit), etag,
    last_modified, headers (array of name and value). A response matches itself (outcome ``full``). A
    revisit is ``resolved`` when ETags agree (weak marks aside), or, if one lacks an ETag, when the
    last_modified agree; ``unconfirmed`` when neither can be compared; ``changed`` when they differ;
    ``no_response`` without a response strictly earlier. Of responses of one time the largest
    record_id counts. Only resolved rows merge headers; others keep their own. Null URLs and times
    match nothing; a null kind is a revisit; null headers are none; other columns are ignored; an empty table gives no rows.
    Repeated rows are resolved alike, each on its own; of responses with one id, URL and time that differ
    the least by ETag, last_modified and headers counts. A response without an id can be repeated; its
    matched_id is null.
    """
    url = canonical_url(F.col("url"))
    rows = captures.select(
        F.col("record_id").cast("long").alias("record_id"),
        "kind",
        url.alias("canonical_url"),
        F.col("ts").cast("long").alias("ts"),
        "etag",
        "last_modified",
        F.coalesce(F.col("headers"), F.array().cast(HEADERS)).alias("headers"),
    )
    full = F.coalesce(F.col("kind") == "response", F.lit(False))
    # A row with a null URL or time has no key and no part in the lookup.
    rows = rows.withColumn("key", F.when(F.col("ts").isNotNull(), F.col("canonical_url")))
    narrow = rows.filter("key IS NOT NULL").select("record_id", "ts", full.alias("full"), "key", F.floor(F.col("ts") / stretch).alias("stretch"))
    latest = F.max(F.when(F.col("full"), F.struct("ts", "record_id")))
    within = Window.partitionBy("key", "stretch").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = narrow.groupBy("key", "stretch").agg(latest.alias("last")).withColumn("carried", F.max("last").over(earlier)).select("key", "stretch", "carried")
    found = narrow.withColumn("inside", latest.over(within)).filter("NOT full").join(carried, ["key", "stretch"])
    # What is found depends on URL and time alone: one row for each of them, however many records have both.
    hit = F.coalesce("inside", "carried")
    found = found.select("key", "ts", hit["record_id"].alias("found_id"), hit["ts"].alias("found_ts")).filter("found_ts IS NOT NULL").dropDuplicates(["key", "ts"])
    stored = rows.filter(full & F.col("key").isNotNull()).groupBy("key", F.col("ts").alias("found_ts"), F.col("record_id").alias("found_id")).agg(F.min(F.struct("etag", "last_modified", "headers")).alias("s"))
    stored = stored.alias("r")
    same = (F.col("f.key") == F.col("r.key")) & (F.col("f.found_ts") == F.col("r.found_ts")) & F.col("f.found_id").eqNullSafe(F.col("r.found_id"))
    found = found.alias("f").join(stored, same).select("f.*", F.col("r.s.etag").alias("s_etag"), F.col("r.s.last_modified").alias("s_modified"), F.col("r.s.headers").alias("s_headers"))

    joined = rows.filter(~full).join(found, ["key", "ts"], "left")
    tags = F.col("etag").isNotNull() & F.col("s_etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("s_modified").isNotNull()
    agree = F.when(tags, _strong("etag") == _strong("s_etag")).when(dates, F.col("last_modified") == F.col("s_modified"))
    outcome = F.when(F.col("found_ts").isNull(), "no_response").when(agree.isNull(), "unconfirmed").when(agree, "resolved").otherwise("changed")
    joined = joined.withColumn("outcome", outcome)
    joined = joined.withColumn("sent", F.filter("headers", lambda h: F.lower(h["name"]).isin(*PERMITTED)))
    merged = F.concat(F.filter("s_headers", lambda h: ~F.exists("sent", lambda s: F.lower(s["name"]) == F.lower(h["name"]))), F.col("sent"))
    revisits = joined.select(
        "record_id",
        "kind",
        "canonical_url",
        "ts",
        F.when(F.col("outcome") == "resolved", F.col("found_id")).alias("matched_id"),
        "outcome",
        F.when(F.col("outcome") == "resolved", merged).otherwise(F.col("headers")).alias("headers"),
    )
    responses = rows.filter(full).select("record_id", "kind", "canonical_url", "ts", F.col("record_id").alias("matched_id"), F.lit("full").alias("outcome"), "headers")
    return responses.unionByName(revisits)


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures from the table of pages: each page as a full response, and a revisit of it.

    Page p is captured at time 10 p and revisited 5 later, or 5 earlier where 5 divides p; where p is 3
    modulo 4 the revisit carries another ETag.
    """
    tag = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    page, ts = F.col("page_id").cast("long"), F.col("page_id").cast("long") * 10
    responses = pages.select(
        (page * 2).alias("record_id"),
        "url",
        ts.alias("ts"),
        F.lit("response").alias("kind"),
        tag.alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.array(header("Content-Type", F.lit("text/html")), header("Content-Length", F.octet_length(F.coalesce(F.col("html"), F.lit("")))), header("Date", ts), header("ETag", tag)).alias("headers"),
    )
    again = F.when(page % 5 == 0, ts - 5).otherwise(ts + 5)
    other = F.when(page % 4 == 3, F.lit("other")).otherwise(tag)
    revisits = pages.select(
        (page * 2 + 1).alias("record_id"),
        F.concat("url", F.lit("#again")).alias("url"),
        again.alias("ts"),
        F.lit("revisit").alias("kind"),
        F.concat(F.lit("W/"), other).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.array(header("Date", again), header("Cache-Control", F.lit("max-age=60")), header("Content-Length", F.lit(0))).alias("headers"),
    )
    return responses.unionByName(revisits)


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_join(F.array_sort(F.transform("headers", lambda h: F.concat(F.lower(h["name"]), F.lit(": "), h["value"]))), "\n")
    return found.withColumn("headers", lines)


ORACLE = {
    "op3_revisits": r"""
WITH u AS (SELECT page_id, html, regexp_replace(regexp_replace(url, '#.*', '', 'g'), '^[A-Za-z]+://(www\.|m\.)?', '') AS u FROM pages),
h AS (SELECT *, regexp_extract(u, '^[^/?]*', 0) AS host FROM u),
p AS (SELECT CAST(page_id AS BIGINT) AS page_id, md5(coalesce(html, '')) AS tag, CAST(strlen(coalesce(html, '')) AS VARCHAR) AS size,
        lower(host) || regexp_replace(regexp_replace(regexp_replace(substr(u, length(host) + 1), '&(utm_[a-z]+|ref)=[^&]*', '', 'g'), '\?(utm_[a-z]+|ref)=[^&]*&?', '?', 'g'), '[?&/]+$', '', 'g') AS canonical_url FROM h),
v AS (SELECT page_id * 2 + 1 AS record_id, canonical_url, CASE WHEN page_id % 5 = 0 THEN page_id * 10 - 5 ELSE page_id * 10 + 5 END AS ts,
        CASE WHEN page_id % 4 = 3 THEN 'other' ELSE tag END AS tag FROM p),
j AS (SELECT v.*, r.page_id AS rp, r.tag AS rtag, r.size AS rsize,
        row_number() OVER (PARTITION BY record_id ORDER BY r.page_id DESC NULLS LAST) AS rn
      FROM v LEFT JOIN p r ON r.canonical_url = v.canonical_url AND r.page_id * 10 < v.ts),
o AS (SELECT *, CASE WHEN rp IS NULL THEN 'no_response' WHEN rtag = tag THEN 'resolved' ELSE 'changed' END AS outcome FROM j WHERE rn = 1)
SELECT record_id, 'revisit' AS kind, canonical_url, ts, CASE WHEN outcome = 'resolved' THEN rp * 2 END AS matched_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || rsize || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || rtag
    ELSE 'cache-control: max-age=60' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || ts END AS headers FROM o
UNION ALL
SELECT page_id * 2, 'response', canonical_url, page_id * 10, page_id * 2, 'full',
  'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || page_id * 10 || chr(10) || 'etag: ' || tag FROM p""",
}
