"""One long catalog of all aggregates, and a dictionary of its columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import record_id

KEYS = ("analysis_set", "station_id", "archive_group", "action_bin", "window", "evidence_tier", "mapping_class", "metric", "effect_scale")


def catalog(views: dict[str, DataFrame]) -> DataFrame:
    """All views (name to aggregates) as one table: record_id, view, their key columns, and every other column of any view."""
    parts = []
    for name, df in views.items():
        keys = [c for c in KEYS if c in df.columns]
        source = F.concat_ws("/", *[F.col(c).cast("string") for c in keys])
        # A key is text in one view and a number in another.
        casts = [F.col(c).cast("string").alias(c) if c in KEYS else F.col(c).cast("double").alias(c) for c in df.columns]
        parts.append(df.withColumn("_source", source).select(record_id(F.lit(name), F.col("_source")).alias("record_id"), F.lit(name).alias("view"), F.col("_source").alias("source_record"), *casts))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dictionary(df: DataFrame, artifact: str) -> DataFrame:
    """artifact, field, data_type, nullable, distinct values: the narrowest type that all non-empty values read as. One pass."""
    cells = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(df.columns)]
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    empty = F.col("value").isNull() | (F.trim("value") == "")
    fits = lambda kind: F.bool_and(F.when(~empty, F.col("value").try_cast(kind).isNotNull()))
    yes_no = F.bool_and(F.when(~empty, F.lower("value").isin("true", "false", "yes", "no")))
    out = long.groupBy("position", "field").agg(yes_no.alias("b"), fits("bigint").alias("i"), fits("double").alias("n"), F.max(empty).alias("nullable"))
    kind = F.when(F.col("b").isNull(), "empty").when(F.col("b"), "boolean").when(F.col("i"), "integer").when(F.col("n"), "number").otherwise("string")
    return out.select(F.lit(artifact).alias("artifact"), "field", kind.alias("data_type"), "nullable")
