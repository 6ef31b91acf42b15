"""Scalar derivations shared by the operators, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Salts of public tokens, and the modes that count as context given up front.
EPISODE_SALT = "new-submission-v1|"
LINKAGE_SALT = "inheritance-pilot-v2|"
FRONTLOAD_MODES = ("bounded_package", "multi_source_synthesis", "standards_constraints", "examples_templates")

TRACE = "array<struct<order:int,name:string,class:string,completed:boolean,succeeded:boolean,target_ref:string>>"


def whole(c: Column | str, default: int = 0) -> Column:
    """Integer from text, ``default`` where it is none."""
    return F.coalesce(F.col(c).try_cast("bigint") if isinstance(c, str) else c.try_cast("bigint"), F.lit(default).cast("bigint"))


def yes(c: Column) -> Column:
    return F.when(c, "yes").otherwise("no")


def is_yes(c: Column) -> Column:
    return (F.lower(c) == "yes").cast("int")


def mask(c: Column) -> Column:
    """Array from a pipe-joined set; empty members go."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != "")


def canonical_mask(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(mask(c))), "|")


def token(prefix: str, value: Column, salt: str = "", digits: int = 20) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat(F.lit(salt), value).cast("binary"), 256), 1, digits))


def stable_rank(c: Column) -> Column:
    return F.sha2(c.cast("string").cast("binary"), 256)


def month(timestamp_text: Column) -> Column:
    """Year and month as written, in the text's own offset; null for an empty text."""
    return F.nullif(F.substring(timestamp_text, 1, 7), F.lit(""))


def duration_minutes(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", start, end) / 6e7)


def per_action(duration: Column, actions: Column) -> Column:
    return F.when(actions > 0, duration / actions)


def frontloaded(attachments: Column, references: Column, modes: Column) -> Column:
    return (attachments > 0) | (references >= 2) | F.arrays_overlap(modes, F.array(*[F.lit(m) for m in FRONTLOAD_MODES]))


def trace(c: Column) -> Column:
    return F.from_json(c, TRACE, {"mode": "PERMISSIVE"})


def verification_successful(calls: Column) -> Column:
    return F.coalesce(F.exists(calls, lambda x: (x["class"] == "verify") & x["completed"] & x["succeeded"]), F.lit(False)).cast("int")


def successful_targets(calls: Column) -> Column:
    done = F.filter(calls, lambda x: x["completed"] & x["succeeded"] & (F.coalesce(x["target_ref"], F.lit("")) != ""))
    return F.array_distinct(F.transform(F.coalesce(done, F.array().cast(TRACE)), lambda x: x["target_ref"]))


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != ""))


def session_of(source_ref: Column) -> Column:
    return F.when(source_ref.startswith("SRC-"), F.concat(F.lit("SS-"), F.substring(source_ref, 5, 1 << 20))).otherwise(source_ref)


def record_id(view: Column, source_record: Column) -> Column:
    return F.concat(F.lit("AGG-"), F.substring(F.sha2(F.concat(view, F.lit("|"), source_record).cast("binary"), 256), 1, 12))


def effect(ce: Column, comparison: Column, scale: Column) -> Column:
    """Difference or ratio by the scale's name; any other scale is an error."""
    return F.when(scale.contains("risk_difference"), ce - comparison).when(scale.contains("ratio"), F.when(comparison > 0, ce / comparison)).otherwise(F.raise_error(F.concat(F.lit("unknown scale "), scale)).cast("double"))


def exact_count(rate: Column, n: Column) -> Column:
    """The numerator of a rate; an error when rate * n is no whole number to 1e-9."""
    k = F.round(rate * n)
    return F.when(F.abs(rate * n - k) <= 1e-9, k.cast("long")).otherwise(F.raise_error(F.lit("rate is no count over n")).cast("long"))


def first_given(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def sign_test(positive: Column, negative: Column) -> Column:
    """Exact two-sided sign test; null when nothing has a sign. Binomial terms by running products, so any n."""
    n, k = (positive + negative).cast("double"), F.least(positive, negative).cast("int")
    step = lambda s, i: F.struct((s["term"] * F.when(i == 0, 1.0).otherwise((n - i + 1) / i)).alias("term"), (s["sum"] + s["term"] * F.when(i == 0, 1.0).otherwise((n - i + 1) / i)).alias("sum"))
    start = F.struct(F.pow(F.lit(2.0), -n).alias("term"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0), k), start, step, lambda s: s["sum"])
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))
