"""Effects between the arms: pooled, by station, by group, equal-station, by minimum size, binned and standardized."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sign_test

BINARY = ("verification_successful", "audit_signal", "remediation_signal", "packaging_release_signal", "multistage_signal", "grounded_decision_trace")
RATIO = ("duration_min", "completed_substantive_actions", "min_per_action")
#: Effects this near to none count as ties.
DEAD_BAND = 1e-12


def arm_effects(rows: DataFrame, by: Sequence[str], ratio_scale: str = "ratio_of_condition_medians", stations: bool = False, strict: bool = False) -> DataFrame:
    """``by``, metric, effect_scale, ce_value, comparison_value, effect, rows_per_condition.

    Binary metrics: difference of rates. Ratio metrics: quotient of exact medians, null when the
    comparison median isn't above 0. An arm without rows gives null. One aggregation over all metrics:
    the medians keep a count of each distinct value, not the rows. ``stations``: also how many contribute.
    ``strict``: arms of unequal size are an error when the rows are read.
    """
    ce, other = F.col("arm") == "ce", F.col("arm") == "comparison"
    n = F.count_if(ce)
    if strict:
        n = F.when(F.count_if(ce) == F.count_if(other), n).otherwise(F.raise_error(F.lit("arms of unequal size")).cast("long"))
    aggs = [n.alias("n")] + ([F.size(F.collect_set("station_id")).cast("long").alias("contributing_stations")] if stations else [])
    more = ["contributing_stations"] if stations else []
    for m in BINARY:
        aggs += [F.avg(F.when(ce, F.col(m))).alias(f"ce_{m}"), F.avg(F.when(other, F.col(m))).alias(f"cmp_{m}")]
    for m in RATIO:
        aggs += [F.median(F.when(ce, F.col(m))).alias(f"ce_{m}"), F.median(F.when(other, F.col(m))).alias(f"cmp_{m}")]
    wide = rows.groupBy(*by).agg(*aggs)
    cells = [F.struct(F.lit(m).alias("metric"), F.lit("risk_difference" if m in BINARY else ratio_scale).alias("effect_scale"), F.col(f"ce_{m}").alias("ce_value"), F.col(f"cmp_{m}").alias("comparison_value")) for m in (*BINARY, *RATIO)]
    long = wide.select(*by, "n", *more, F.explode(F.array(*cells)).alias("c")).select(*by, "c.*", F.col("n").alias("rows_per_condition"), *more)
    ratio = F.when(F.col("comparison_value") > 0, F.col("ce_value") / F.col("comparison_value"))
    return long.withColumn("effect", F.when(F.col("effect_scale") == "risk_difference", F.col("ce_value") - F.col("comparison_value")).otherwise(ratio))


def equal_station(effects: DataFrame, by: Sequence[str] = ("analysis_set",)) -> DataFrame:
    """Each station counts once: mean difference, or geometric mean of ratios above 0; signs and their test."""
    binary = F.col("effect_scale").contains("risk_difference")
    used = effects.filter(F.col("effect").isNotNull() & (binary | (F.col("effect") > 0)))
    none = F.when(binary, 0.0).otherwise(1.0)
    out = used.groupBy(*by, "metric").agg(
        F.count(F.lit(1)).alias("stations"),
        F.when(F.bool_and(binary), F.avg("effect")).otherwise(F.exp(F.avg(F.when(~binary, F.log("effect"))))).alias("effect"),
        F.count_if(F.col("effect") > none + DEAD_BAND).alias("positive_stations"),
        F.count_if(F.abs(F.col("effect") - none) <= DEAD_BAND).alias("tie_stations"),
        F.count_if(F.col("effect") < none - DEAD_BAND).alias("negative_stations"),
    )
    return out.withColumn("descriptive_sign_p", sign_test(F.col("positive_stations"), F.col("negative_stations")))


def at_least(effects: DataFrame, size: int) -> DataFrame:
    """Effects of stations with at least ``size`` rows in each arm."""
    return effects.filter(F.col("rows_per_condition") >= size).withColumn("analysis_set", F.concat("analysis_set", F.lit(f"_min{size}")))


def action_bins(rows: DataFrame, by: Sequence[str], bins: Sequence[tuple[str, int, int | None]], metric: str = "verification_successful", strict: bool = False) -> DataFrame:
    """Rate of ``metric`` by bin of actions in each arm, gap, and the bin's share of the comparison arm.

    ``strict``: a bin without rows of both arms is an error, as are arms of unequal size; otherwise it has null rates.
    """
    label = F.lit(None).cast("string")
    for name, low, high in bins:
        label = F.when((F.col("actions") >= low) & (F.lit(True) if high is None else F.col("actions") <= high), F.lit(name)).otherwise(label)
    ce, other = F.col("arm") == "ce", F.col("arm") == "comparison"
    hit = F.col(metric) == 1
    cells = rows.withColumn("action_bin", label).filter("action_bin IS NOT NULL").groupBy(*by, "action_bin").agg(F.count_if(ce & hit).alias("ce_k"), F.count_if(ce).alias("ce_n"), F.count_if(other & hit).alias("comparison_k"), F.count_if(other).alias("comparison_n"))
    over = Window.partitionBy(*by)  # a row a bin
    out = cells.withColumns({"_all": F.sum("comparison_n").over(over), "_ce": F.sum("ce_n").over(over)})
    for a in ("ce", "comparison"):
        out = out.withColumn(f"{a}_rate", F.when(F.col(f"{a}_n") > 0, F.col(f"{a}_k") / F.col(f"{a}_n")))
    if strict:
        fine = (F.col("ce_n") > 0) & (F.col("comparison_n") > 0) & (F.col("_all") == F.col("_ce"))
        out = out.withColumn("ce_rate", F.when(fine, F.col("ce_rate")).otherwise(F.raise_error(F.lit("empty bin or unequal arms")).cast("double")))
    out = out.withColumn("gap", F.col("ce_rate") - F.col("comparison_rate"))
    return out.withColumn("comparison_weight", F.when(F.col("_all") > 0, F.col("comparison_n") / F.col("_all"))).drop("_all", "_ce")


def standardized_gap(bins: DataFrame, by: Sequence[str]) -> DataFrame:
    """Raw gap, and the gap with the comparison arm's mix of bins."""
    raw = F.sum("ce_k") / F.nullif(F.sum("ce_n"), F.lit(0)) - F.sum("comparison_k") / F.nullif(F.sum("comparison_n"), F.lit(0))
    return bins.groupBy(*by).agg(raw.alias("raw_gap"), F.sum(F.col("gap") * F.col("comparison_weight")).alias("standardized_gap"))
