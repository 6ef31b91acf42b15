"""Ranks and as-of lookups that never put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(df: DataFrame, group: Sequence[str], hash_hex: str, tie: str, out: str = "rank", digits: int = 3) -> DataFrame:
    """Rank from 1 within ``group`` by a hexadecimal hash, then ``tie``.

    A hash's leading digits split a group evenly and in rank order: rows are numbered within
    (group, leading digits), and each bucket adds the sizes of the buckets before it. A group of any
    size is spread over 16**digits tasks; the table of sizes has that many rows a group at most.
    """
    lead = df.withColumn("_lead", F.substring(hash_hex, 1, digits))
    sizes = lead.groupBy(*group, "_lead").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_lead").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, "_lead").orderBy(hash_hex, tie)
    placed = lead.withColumn("_row", F.row_number().over(within))
    cond = F.col("_lead") == F.col("_at")
    for c in group:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return placed.join(offsets, cond).withColumn(out, F.col("_row") + F.col("_before")).select(*df.columns, out)


def latest_before(df: DataFrame, key: Sequence[str], order: Sequence[str], wanted: Column, payload: Sequence[str], out: str, stretch: int) -> DataFrame:
    """Adds ``out``: order and payload columns (a struct) of the latest earlier row of the same key where ``wanted``, else null.

    ``order`` begins with an integer; its stretches of ``stretch`` units bound what one window sees.
    The last wanted row of each stretch is carried on through a table of one row a stretch.
    """
    value = F.when(wanted, F.struct(*order, *payload))
    rows = df.withColumn("_stretch", F.floor(F.col(order[0]) / stretch))
    within = Window.partitionBy(*key, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(*key, "_stretch").agg(F.max(value).alias("_last")).withColumn("_carried", F.max("_last").over(across))
    last = last.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("_stretch").alias("_at"), "_carried")
    cond = F.col("_stretch") == F.col("_at")
    for c in key:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    found = rows.withColumn("_inside", F.max(value).over(within)).join(last, cond)
    return found.withColumn(out, F.coalesce("_inside", "_carried")).select(*df.columns, out)


def running_count(df: DataFrame, key: Sequence[str], order: str, out: str, stretch: int) -> DataFrame:
    """Adds ``out``: the row's place from 1 within its key by an integer ``order``, numbered stretch by stretch."""
    rows = df.withColumn("_stretch", F.floor(F.col(order) / stretch))
    across = Window.partitionBy(*key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*key, "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("_stretch").alias("_at"), F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    cond = F.col("_stretch") == F.col("_at")
    for c in key:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = rows.withColumn("_row", F.row_number().over(Window.partitionBy(*key, "_stretch").orderBy(order)))
    return placed.join(sizes, cond).withColumn(out, F.col("_row") + F.col("_before")).select(*df.columns, out)
