"""Cohorts and their deterministic one-to-one balance within strata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stable_rank, token
from .ranking import hash_rank

# What makes a row eligible, and the labels of the arms.
ORIGIN = "direct_or_unresolved_user_level"
CE_DISPOSITION = "candidate_strong"
COMPARISON_DISPOSITION = "exclude_no_context_operation"
CE_LABEL = "CE_ORDERED_ACTION"
PRIMARY_CE_LABEL = "CE_FRONTLOADED_ORDERED_ACTION"
COMPARISON_LABEL = "ROUTED_COMPARISON_ACTION"
STRATUM = ("station_id", "provider", "month")


def cohorts(ep: DataFrame) -> DataFrame:
    """Eligible rows with their cohort; rows of neither arm go."""
    eligible = (F.col("actions") > 0) & (F.col("origin") == ORIGIN) & (F.coalesce(F.lower("publication"), F.lit("")) != "yes")
    arm = F.when(F.col("disposition") == CE_DISPOSITION, CE_LABEL).when(F.col("disposition") == COMPARISON_DISPOSITION, COMPARISON_LABEL)
    return ep.filter(eligible).withColumn("cohort", arm).filter("cohort IS NOT NULL")


def arms(rows: DataFrame, primary: bool) -> tuple[DataFrame, DataFrame]:
    """CE arm (frontloaded rows only, where ``primary``) and comparison arm."""
    ce = rows.filter(F.col("cohort") == CE_LABEL)
    return (ce.filter("frontloaded") if primary else ce), rows.filter(F.col("cohort") == COMPARISON_LABEL)


def strata(ce: DataFrame, comparison: DataFrame, stratum: Sequence[str] = STRATUM) -> DataFrame:
    """Rows available in each arm, and how many can be paired, for strata that have both."""
    a = ce.groupBy(*stratum).agg(F.count(F.lit(1)).alias("ce_available"))
    b = comparison.groupBy(*stratum).agg(F.count(F.lit(1)).alias("comparison_available"))
    return a.join(b, list(stratum)).withColumn("balanced_per_condition", F.least("ce_available", "comparison_available"))


def balance(ce: DataFrame, comparison: DataFrame, stratum: Sequence[str] = STRATUM) -> DataFrame:
    """stratum, rank, ce_id, comparison_id, sample_link_id: rows of equal hash rank in a stratum are a pair."""
    ranked = lambda df, name: hash_rank(df.select(*stratum, F.col("episode_id").alias(name), stable_rank(F.col("episode_id")).alias("h")), stratum, "h", name).drop("h")
    pairs = ranked(ce, "ce_id").join(ranked(comparison, "comparison_id"), [*stratum, "rank"])
    return pairs.withColumn("sample_link_id", link_id(stratum))


def both_sets(rows: DataFrame, stratum: Sequence[str] = STRATUM) -> DataFrame:
    """Balanced rows of the unrestricted and of the primary (frontloaded) set, with analysis_set, arm, rank and sample_link_id.

    One pass: a row is in the sample when its hash rank in its set, arm and stratum is no more than both
    arms have there, so no arm is joined to the other. ``rows`` should be cheap to read twice.
    """
    primary = F.when((F.col("cohort") != CE_LABEL) | F.col("frontloaded"), F.lit("primary_frontloaded"))
    tagged = rows.withColumn("analysis_set", F.explode(F.array_compact(F.array(F.lit("unrestricted"), primary))))
    group = ["analysis_set", *stratum]
    ce = F.col("cohort") == CE_LABEL
    both = tagged.groupBy(*group).agg(F.least(F.count_if(ce), F.count_if(~ce)).alias("_k")).filter("_k > 0")
    ranked = hash_rank(tagged.withColumn("_h", stable_rank(F.col("episode_id"))), [*group, "cohort"], "_h", "episode_id").drop("_h")
    chosen = ranked.join(both, group).filter("rank <= _k").drop("_k")
    return chosen.withColumn("arm", F.when(ce, "ce").otherwise("comparison")).withColumn("sample_link_id", link_id(stratum))


def link_id(stratum: Sequence[str]) -> Column:
    key = F.format_string("('%s', '%s', '%s')|%d", *[F.col(c) for c in stratum], F.col("rank"))
    return token("LINK", key, digits=16)
