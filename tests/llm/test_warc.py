from pyspark.sql import functions as F

from trailstat.llm import warc

SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers array<struct<name:string,value:string>>, outcome string"


def rows(spark, *records):
    return spark.createDataFrame([(*r, "extra") for r in records], SCHEMA)


def outcomes(df):
    return {r["record_id"]: (r["outcome"], r["matched_id"]) for r in df.collect()}


def test_latest_earlier_response_by_canonical_url(spark):
    h = [("Date", "d")]
    df = rows(
        spark,
        (1, "http://www.A.org/x/", 10, "response", "e1", None, h),
        (2, "https://a.org/x?utm_source=f#top", 20, "response", "e2", None, h),
        (3, "http://m.a.org/x", 20, "response", "e3", None, h),  # a tie: the larger id
        (4, "http://a.org/x", 20, "revisit", "e1", None, h),  # strictly earlier only
        (5, "http://a.org/x", 25, "revisit", "W/e3", None, h),
        (6, "http://a.org/x", 30, "revisit", "e1", None, h),  # the latest one differs
        (7, "http://a.org/X", 30, "revisit", "e1", None, h),  # paths keep their case
        (8, None, 30, "revisit", "e1", None, None),
        (9, "http://a.org/x", None, "revisit", "e1", None, None),
        (10, "http://b.org/", 5, "response", None, "m", None),
        (11, "http://b.org", 6, "revisit", "e", "m", None),
        (12, "http://b.org", 7, "revisit", None, "n", None),
        (13, "http://b.org", 8, "revisit", "e", None, None),
        (14, None, 1, "response", "e1", None, None),
    )
    want = {1: ("full", 1), 2: ("full", 2), 3: ("full", 3), 4: ("resolved", 1), 5: ("resolved", 3), 6: ("changed", None), 7: ("no_response", None), 8: ("no_response", None), 9: ("no_response", None), 10: ("full", 10), 11: ("resolved", 10), 12: ("changed", None), 13: ("unconfirmed", None), 14: ("full", 14)}
    for stretch in (1, 7, 10_000):
        assert outcomes(warc.resolve_revisits(df, stretch)) == want


def test_only_permitted_headers_are_merged(spark):
    df = rows(
        spark,
        (1, "http://a/", 1, "response", "e", None, [("Content-Length", "9"), ("ETAG", "old"), ("X", "1"), ("X", "2")]),
        (2, "http://a/", 2, "revisit", "e", None, [("Etag", "new"), ("Content-Length", "0"), ("Cache-Control", "c")]),
    )
    (row,) = warc.resolve_revisits(df).filter("record_id = 2").select(F.transform("headers", lambda h: F.concat_ws("=", h["name"], h["value"])).alias("h")).collect()
    assert sorted(row["h"]) == ["Cache-Control=c", "Content-Length=9", "Etag=new", "X=1", "X=2"]


def test_one_url_with_all_records(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://x/").alias("url"), F.when(F.col("id") % 9 != 0, F.col("id").cast("string")).alias("html"))
    a, b = (outcomes(warc.resolve_revisits(warc.page_captures(pages), s)) for s in (13, 10**9))
    assert a == b and len(a) == 800


def test_repeated_rows_and_rows_without_an_id(spark):
    h, other = [("Date", "d")], [("Date", "e")]
    df = rows(
        spark,
        (1, "http://a/", 1, "response", "e", None, h),
        (1, "http://a/", 1, "response", "e", None, h),
        (1, "http://a/", 1, "response", "e", None, other),
        (1, "http://b/", 1, "response", "f", None, h),  # the id of another URL's response
        (2, "http://a/", 2, "revisit", "e", None, None),
        (2, "http://a/", 2, "revisit", "e", None, None),
        (2, "http://b/", 2, "revisit", "f", None, None),
        (None, "http://a/", 2, "revisit", "e", None, None),
        (None, "http://a/", 9, "revisit", "x", None, None),
        (None, "http://c/", 1, "response", "e", None, h),
        (3, "http://c/", 2, "revisit", "e", None, None),
        (None, None, 2, "revisit", "e", None, None),
        (None, None, 1, "response", "e", None, None),
        (4, "http://a/", 2, None, "e", None, None),
    )
    got = sorted(((r["record_id"] is None, r["record_id"] or 0, r["canonical_url"], r["ts"], r["outcome"], r["matched_id"], r["headers"][0]["value"] if r["headers"] else None) for r in warc.resolve_revisits(df).filter("outcome <> 'full'").collect()), key=str)
    a, b = (False, 2, "a", 2, "resolved", 1, "d"), (False, 2, "b", 2, "resolved", 1, "d")
    want = [a, a, b, (True, 0, "a", 2, "resolved", 1, "d"), (True, 0, "a", 9, "changed", None, None), (False, 3, "c", 2, "resolved", None, "d"), (True, 0, None, 2, "no_response", None, None), (False, 4, "a", 2, "resolved", 1, "d")]
    assert got == sorted(want, key=str)
    assert warc.resolve_revisits(df).count() == 14


def test_empty_table(spark):
    assert warc.resolve_revisits(rows(spark, (1, "u", 1, "response", None, None, None)).limit(0)).count() == 0
