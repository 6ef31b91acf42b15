"""Linkage of comparison rows to earlier context rows of their session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import LINKAGE_SALT, token, yes
from .ranking import latest_before

# Dispositions that make a row a predecessor, thresholds, classes, windows and patterns.
CE_DISPOSITIONS = ("candidate_strong", "candidate_probable")
COMPARISON_DISPOSITION = "exclude_no_context_operation"
SHORT_WORDS, CUE_DISTANCE, NEAR_DISTANCE = 30, 20, 3
WINDOWS = (5, 10, 20, 50, 106)
HIGH, PROBABLE = "HIGH_CONFIDENCE_CANDIDATE", "PROBABLE_CANDIDATE"
RULE_VERSION = "ce-inheritance-map/2.0.0-action-eligible-pilot"
CUE = (
    r"\b(?:continue|again|same|previous|prior|original|current|above|what (?:we|you) (?:built|did)|what we built|these|those|this|that|it|them|"
    r"findings|rest|next|rerun|re-run|retest|re-audit|fix|update|apply|verify|audit|complete|finish|keep going|go ahead|do it|start building|"
    r"still|more|all of it|everything found|one more)\b"
)
TICKET = r"(?U)\b[A-Z][A-Z0-9]{1,11}-\d+\b"
PATH = r"(?U)(?<!\w)(?:/[^\s\"'<>|]+)"
FILE = r"(?iU)\b[\w.@+-]{3,}\.(?:md|txt|json|jsonl|csv|tsv|xlsx|xls|docx|pdf|tex|py|mjs|cjs|js|jsx|ts|tsx|html|css|yaml|yml|toml|sh|zip)\b"
PATH_TAIL, LEAST_PATH = ".,;:!?)]}", 8


def continuation_cue(text: Column) -> Column:
    return F.coalesce(text.rlike("(?iU)" + CUE), F.lit(False))


def prompt_anchors(text: Column) -> Column:
    """Distinct tickets, paths and file names of a prompt, marked by kind."""
    all_of = lambda pattern: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    tickets = F.transform(all_of(TICKET), lambda x: F.concat(F.lit("ticket:"), F.upper(x)))
    paths = F.transform(all_of(PATH), lambda x: F.lower(F.rtrim(x, F.lit(PATH_TAIL))))
    paths = F.transform(F.filter(paths, lambda x: F.length(x) >= LEAST_PATH), lambda x: F.concat(F.lit("path:"), x))
    files = F.transform(all_of(FILE), lambda x: F.concat(F.lit("file:"), F.lower(x)))
    return F.array_distinct(F.concat(tickets, paths, files))


def link(rows: DataFrame, stretch: int = 1000) -> DataFrame:
    """One row per comparison row with actions: what links it to an earlier context row, and how surely.

    ``rows``: row_id (unique), session_ref, turn, line, actions, disposition, words, cue (boolean),
    targets and anchors (arrays). A context row has actions and a CE disposition. Everything is an
    as-of lookup by session, or by (session, shared key), so no pairs of rows are made.
    """
    ce = (F.col("actions") > 0) & F.col("disposition").isin(*CE_DISPOSITIONS)
    base = rows.withColumn("is_ce", ce).withColumn("eligible", (F.col("actions") > 0) & (F.col("disposition") == COMPARISON_DISPOSITION))
    order = ["turn", "line", "row_id"]
    narrow = base.select("row_id", "session_ref", "turn", "line", "is_ce", "eligible")
    seen = latest_before(narrow, ["session_ref"], order, F.lit(True), ["is_ce"], "previous", stretch)
    seen = latest_before(seen, ["session_ref"], order, F.col("is_ce"), [], "last_ce", stretch)

    def shared(column: str, name: str) -> DataFrame:
        keys = base.filter("is_ce OR eligible").select("row_id", "session_ref", "turn", "line", "is_ce", "eligible", F.explode(F.array_distinct(column)).alias("key"))
        found = latest_before(keys, ["session_ref", "key"], order, F.col("is_ce"), [], "hit", stretch).filter("eligible AND hit IS NOT NULL")
        return found.groupBy("row_id").agg(F.count(F.lit(1)).alias(f"shared_{name}"), F.max("hit").alias(f"hit_{name}"))

    out = base.filter("eligible").select("row_id", "session_ref", "turn", "words", "cue")
    out = out.join(seen.select("row_id", "previous", "last_ce"), "row_id").join(shared("targets", "targets"), "row_id", "left").join(shared("anchors", "anchors"), "row_id", "left")
    distance = F.col("turn") - F.col("last_ce.turn")
    adjacent = F.coalesce(F.col("previous.is_ce"), F.lit(False))
    rules = [
        (F.col("last_ce").isNull(), "CLEAN_ORIGIN_CANDIDATE", "CLEAN_ORIGIN_CANDIDATE", F.lit(None)),
        (F.col("shared_targets") > 0, "EXACT_SUCCESSFUL_TOOL_TARGET", HIGH, F.lit(0)),
        (F.col("shared_anchors") > 0, "EXACT_PROMPT_ANCHOR", HIGH, F.lit(0)),
        (adjacent & (F.col("words") <= SHORT_WORDS) & F.col("cue"), "IMMEDIATE_SHORT_REFERENCE", HIGH, F.lit(0)),
        (adjacent, "IMMEDIATE_ADJACENCY", PROBABLE, F.lit(1)),
        (F.col("cue") & (distance <= CUE_DISTANCE), "CONTEXT_REFERENCE_WITHIN_20", PROBABLE, distance),
        (distance <= NEAR_DISTANCE, "NEAR_SEQUENCE", PROBABLE, distance),
        (F.lit(True), "UNRESOLVED_PRIOR_CE_SESSION", "UNRESOLVED", F.when(F.col("cue"), distance)),
    ]
    kind = tier = window = None
    for cond, name, level, least in rules:
        kind = F.when(cond, name) if kind is None else kind.when(cond, name)
        tier = F.when(cond, level) if tier is None else tier.when(cond, level)
        window = F.when(cond, least.cast("long")) if window is None else window.when(cond, least.cast("long"))
    matched = F.coalesce(F.greatest("hit_targets", "hit_anchors"), F.col("last_ce"))
    return out.select(
        "row_id",
        "session_ref",
        "turn",
        matched["row_id"].alias("matched_prior_ce"),
        distance.cast("long").alias("turn_distance"),
        F.coalesce("shared_targets", F.lit(0)).alias("shared_targets"),
        F.coalesce("shared_anchors", F.lit(0)).alias("shared_anchors"),
        F.col("cue"),
        kind.alias("mapping_class"),
        tier.alias("evidence_tier"),
        window.alias("minimum_link_window"),
    )


def mapping(links: DataFrame, rows: DataFrame) -> DataFrame:
    """The linkage as it is put out: salted tokens in place of ids, and what marks it as unreviewed. ``rows``: row_id, station_id, provider."""
    own = lambda prefix, c: token(prefix, F.col(c).cast("string"), LINKAGE_SALT, 16)
    return links.join(rows.select("row_id", "station_id", "provider"), "row_id").select(
        own("MAP", "row_id").alias("mapping_id"),
        own("EP", "row_id").alias("episode_token"),
        "station_id",
        "provider",
        own("SESSION", "session_ref").alias("session_token"),
        F.col("turn").alias("turn_index"),
        F.coalesce(own("EP", "matched_prior_ce"), F.lit("")).alias("matched_prior_ce_token"),
        F.col("turn_distance").alias("turn_distance_from_latest_ce"),
        F.col("shared_targets").alias("shared_successful_tool_targets"),
        F.col("shared_anchors").alias("shared_prompt_anchors"),
        yes(F.col("cue")).alias("explicit_continuation_reference"),
        "mapping_class",
        "evidence_tier",
        "minimum_link_window",
        F.lit("pending").alias("human_review_status"),
        F.lit(RULE_VERSION).alias("rule_version"),
    )


def window_curve(links: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Positives and their rate by window: high tier, or a window that reaches the row's least one. One pass."""
    reach = lambda w: F.count_if((F.col("evidence_tier") == HIGH) | (F.col("evidence_tier").isin(PROBABLE, "UNRESOLVED") & (F.col("minimum_link_window") <= w)))
    eligible = F.count_if(F.col("evidence_tier") != "CLEAN_ORIGIN_CANDIDATE")
    one = links.agg(eligible.alias("eligible_rows"), F.array(*[F.struct(F.lit(w).alias("window"), reach(w).alias("candidate_positive")) for w in windows]).alias("c"))
    out = one.select("eligible_rows", F.explode("c").alias("c")).select("c.window", "c.candidate_positive", "eligible_rows")
    return out.withColumn("candidate_positive_rate", F.when(F.col("eligible_rows") > 0, F.col("candidate_positive") / F.col("eligible_rows"))).withColumn("unresolved", F.col("eligible_rows") - F.col("candidate_positive"))
