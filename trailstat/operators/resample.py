"""Bootstrap intervals of a mean over few values (stations)."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPETITIONS = 50_000
SEED = 20260815


def linear_quantile(ordered: Sequence[float], q: float) -> float:
    """Quantile of sorted values by linear interpolation at (n - 1) q."""
    at = (len(ordered) - 1) * q
    low, high = math.floor(at), math.ceil(at)
    return ordered[low] if low == high else ordered[low] * (1 - (at - low)) + ordered[high] * (at - low)


def seeded_interval(values: Sequence[float], salt: str, repetitions: int = REPETITIONS, seed: int = SEED) -> tuple[float, float]:
    """Percentile interval of the mean over draws of a Mersenne Twister whose seed is a hash of seed and salt."""
    rng = random.Random(int(hashlib.sha256(f"{seed}:{salt}".encode()).hexdigest()[:16], 16))
    n = len(values)
    means = sorted(sum([values[rng.randrange(n)] for _ in range(n)]) / n for _ in range(repetitions))
    return linear_quantile(means, 0.025), linear_quantile(means, 0.975)


def exact_bootstrap(effects: DataFrame, repetitions: int = REPETITIONS, seed: int = SEED) -> DataFrame:
    """analysis_set, metric, effect, ci_low, ci_high from station effects; ratios on the log scale.

    The draws of this generator are a sequence, so each (set, metric) is one Python task; a group has
    as many values as there are stations, and groups run side by side.
    """

    def interval(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("station_id")
        ratio = "ratio" in group["effect_scale"].iloc[0]
        values = [math.log(v) if ratio else v for v in group["effect"] if v == v and (not ratio or v > 0)]
        name, metric = group["analysis_set"].iloc[0], group["metric"].iloc[0]
        if not values:
            return pd.DataFrame([(name, metric, None, None, None)], columns=["analysis_set", "metric", "effect", "ci_low", "ci_high"])
        low, high = seeded_interval(values, f"{name}:{metric}", repetitions, seed)
        out = [sum(values) / len(values), low, high]
        return pd.DataFrame([(name, metric, *([math.exp(v) for v in out] if ratio else out))], columns=["analysis_set", "metric", "effect", "ci_low", "ci_high"])

    few = effects.select("analysis_set", "station_id", "metric", "effect_scale", F.col("effect").cast("double").alias("effect"))
    return few.groupBy("analysis_set", "metric").applyInPandas(interval, "analysis_set string, metric string, effect double, ci_low double, ci_high double")


def with_intervals(table: DataFrame, effects: DataFrame, repetitions: int = REPETITIONS, seed: int = SEED) -> DataFrame:
    """An equal-station ``table`` of ``effects`` with ci_low and ci_high, the exact bootstrap's for each (set, metric); one row a group, so the join is small."""
    return table.join(exact_bootstrap(effects, repetitions, seed).drop("effect"), ["analysis_set", "metric"], "left")


def native_bootstrap(effects: DataFrame, repetitions: int = 500) -> DataFrame:
    """The same interval with draws indexed by a hash, all in expressions: draw d of repetition r takes station md5(r:d) modulo n."""
    ratio = F.col("effect_scale").contains("ratio")
    value = F.when(ratio, F.when(F.col("effect") > 0, F.log("effect"))).otherwise(F.col("effect"))
    groups = effects.withColumn("v", value).filter("v IS NOT NULL").groupBy("analysis_set", "metric").agg(F.array_sort(F.collect_list(F.struct("station_id", "v"))).alias("s"), F.bool_or(ratio).alias("ratio"))
    reps = groups.select("analysis_set", "metric", "ratio", "s", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("r"))
    pick = lambda d: F.conv(F.substring(F.md5(F.concat(F.col("r").cast("string"), F.lit(":"), d.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % F.size("s")
    mean = F.aggregate(F.sequence(F.lit(1), F.size("s")), F.lit(0.0), lambda a, d: a + F.get(F.col("s"), pick(d).cast("int"))["v"]) / F.size("s")
    out = reps.withColumn("m", mean).groupBy("analysis_set", "metric").agg(F.percentile("m", 0.025).alias("l"), F.percentile("m", 0.975).alias("h"), F.bool_or("ratio").alias("ratio"))
    back = lambda c: F.when(F.col("ratio"), F.exp(c)).otherwise(F.col(c))
    return out.select("analysis_set", "metric", back("l").alias("ci_low"), back("h").alias("ci_high"))
