"""Invariants of balanced rows and aggregates: each check counts its violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cohort import STRATUM
from .linkage import HIGH

TOLERANCE = 1e-12


def _count(df: DataFrame, name: str, bad: Column) -> DataFrame:
    return df.agg(F.coalesce(F.count_if(bad), F.lit(0)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def link_invariants(rows: DataFrame) -> DataFrame:
    """check, violations over balanced rows: pairs of one row an arm in one stratum, and row arithmetic."""
    links = rows.groupBy("analysis_set", "sample_link_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("arm") == "ce").alias("ce"),
        *[F.min(c).alias(f"min_{c}") for c in STRATUM],
        *[F.max(c).alias(f"max_{c}") for c in STRATUM],
    )
    torn = reduce(lambda a, b: a | b, [F.col(f"min_{c}") != F.col(f"max_{c}") for c in STRATUM])
    stages = F.col("audit_signal") + F.col("remediation_signal") + F.col("packaging_release_signal")
    return _all(
        [
            _count(links, "two rows a link", F.col("n") != 2),
            _count(links, "one row an arm", F.col("ce") != 1),
            _count(links, "one stratum a link", torn),
            _count(rows, "actions above 0", F.col("actions") <= 0),
            _count(rows, "minutes per action", F.abs(F.col("min_per_action") - F.col("duration_min") / F.nullif(F.col("actions"), F.lit(0))) > TOLERANCE),
            _count(rows, "multistage agrees", (F.col("multistage_signal") == 1) != (stages >= 2)),
            _count(rows, "primary context rows frontloaded", (F.col("analysis_set") == "primary_frontloaded") & (F.col("arm") == "ce") & ~F.col("frontloaded")),
        ]
    )


def strata_agree(rows: DataFrame, strata: DataFrame, analysis_set: str) -> DataFrame:
    """Strata whose selected pairs differ from what the availability table says."""
    used = rows.filter((F.col("analysis_set") == analysis_set) & (F.col("arm") == "ce")).groupBy(*STRATUM).agg(F.count(F.lit(1)).alias("selected"))
    both = strata.join(used, list(STRATUM), "full_outer")
    enough = (F.col("ce_available") >= F.col("selected")) & (F.col("comparison_available") >= F.col("selected"))
    return both.filter(~((F.col("selected") == F.col("balanced_per_condition")) & enough) | F.col("selected").isNull() | F.col("balanced_per_condition").isNull())


def same_values(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Keys that only one table has, that occur twice, or whose values differ by more than ``tolerance``."""
    one = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("na"), *[F.first(v).alias(f"a_{v}") for v in values])
    two = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("nb"), *[F.first(v).alias(f"b_{v}") for v in values])
    apart = reduce(lambda x, y: x | y, [(F.col(f"a_{v}").isNull() != F.col(f"b_{v}").isNull()) | (F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) > tolerance) for v in values])
    return one.join(two, keys, "full_outer").filter(F.coalesce(F.col("na") != 1, F.lit(True)) | F.coalesce(F.col("nb") != 1, F.lit(True)) | F.coalesce(apart, F.lit(False))).select(*keys)


def bin_checks(bins: DataFrame, by: list[str]) -> DataFrame:
    """check, violations: weights of a set sum to 1, rates are k / n."""
    sums = bins.groupBy(*by).agg(F.sum("comparison_weight").alias("w"))
    rate = lambda a: F.abs(F.col(f"{a}_rate") - F.col(f"{a}_k") / F.nullif(F.col(f"{a}_n"), F.lit(0))) > TOLERANCE
    return _all([_count(sums, "weights sum to 1", F.abs(F.col("w") - 1) > TOLERANCE), _count(bins, "context rate", rate("ce")), _count(bins, "comparison rate", rate("comparison"))])


def curve_checks(links: DataFrame, curve: DataFrame) -> DataFrame:
    """check, violations: the curve never falls, and unresolved rows are what is left."""
    pairs = curve.alias("a").join(F.broadcast(curve).alias("b"), F.expr("a.window < b.window"))  # a row a window
    return _all(
        [
            _count(pairs, "curve never falls", F.col("a.candidate_positive") > F.col("b.candidate_positive")),
            _count(curve, "unresolved", F.col("unresolved") != F.col("eligible_rows") - F.col("candidate_positive")),
            _count(links, "high tier has window 0", (F.col("evidence_tier") == HIGH) & (F.coalesce(F.col("minimum_link_window"), F.lit(-1)) != 0)),
        ]
    )


def orphans(claims: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Claims whose ``key`` no file has."""
    return claims.join(files.select(key).distinct(), key, "left_anti")
