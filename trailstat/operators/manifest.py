"""File manifests by SHA-256, and the difference of two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(files: DataFrame) -> DataFrame:
    """path, sha256 of files (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def entry_lines(entries: DataFrame) -> DataFrame:
    """One text line an entry, in the order of the entries; one without a path is its hash alone."""
    return entries.select(F.concat("sha256", F.coalesce(F.concat(F.lit("  "), "path"), F.lit(""))).alias("value"))


def manifest_lines(entries: DataFrame) -> DataFrame:
    """One text line an entry, sorted by path."""
    return entry_lines(entries.orderBy("path"))


def parse_lines(lines: DataFrame, *more: str) -> DataFrame:
    """path, sha256 (and ``more`` columns) of lines (value); blank ones go."""
    path = F.when(F.length("value") > 64, F.substring("value", 67, 1 << 20))
    return lines.filter("trim(value) <> ''").select(*more, path.alias("path"), F.substring("value", 1, 64).alias("sha256"))


def difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, status: missing, unlisted or changed; equal files aren't listed."""
    e, a = expected.select("path", F.col("sha256").alias("expected")), actual.select("path", F.col("sha256").alias("actual"))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unlisted").when(F.col("expected") != F.col("actual"), "changed")
    return e.join(a, "path", "full_outer").select("path", status.alias("status")).filter("status IS NOT NULL")


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one and not the other, counted as often as they occur, with the side they are on."""
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("after")))
