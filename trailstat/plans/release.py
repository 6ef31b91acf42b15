"""Queries of what is published and verified: tokens, transforms, catalog, boundary, round trips, and checks over planted violations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json
from ..functions.scalars import EPISODE_SALT, LINKAGE_SALT, effect
from ..operators import boundary, checks, cohort, effects, linkage, manifest, resample, screen
from ..operators.catalog import catalog
from ..registry import query
from ..sources import readers, writers
from ..sources.shared import shared_folder, spool
from . import comparison as c
from . import transcripts as t
from .adapters import table

_TOKEN = lambda prefix, value, salt: f"'{prefix}-' || substr(sha256('{salt}' || {value}), 1, 16)"


@query("linkage_output", c.LINK_SQL + f"""SELECT {_TOKEN('MAP', 'l.row_id', LINKAGE_SALT)} AS mapping_id, {_TOKEN('EP', 'l.row_id', LINKAGE_SALT)} AS episode_token, station_id, provider, {_TOKEN('SESSION', 'l.session_ref', LINKAGE_SALT)} AS session_token, l.turn AS turn_index,
coalesce({_TOKEN('EP', 'l.matched_prior_ce', LINKAGE_SALT)}, '') AS matched_prior_ce_token, turn_distance AS turn_distance_from_latest_ce, shared_targets AS shared_successful_tool_targets, shared_anchors AS shared_prompt_anchors, CASE WHEN l.cue THEN 'yes' ELSE 'no' END AS explicit_continuation_reference,
mapping_class, evidence_tier, minimum_link_window, 'pending' AS human_review_status, '{linkage.RULE_VERSION}' AS rule_version FROM links l JOIN ep ON ep.episode_id = l.row_id""")
def linkage_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c._linkable(spark, sf_dir)
    return linkage.mapping(linkage.link(rows), rows)


_AT = lambda x: f"CASE WHEN {x} NOT IN ('', 'no time') THEN CAST(replace(replace({x}, 'T', ' '), 'Z', '') AS TIMESTAMP) END"


@query("episode_transform", t.SCREEN_SQL + f""", v AS (SELECT 'SRC-' || c AS source_ref, start AS source_line_start, bool_or(class = 'verify' AND completed AND succeeded) AS verified FROM oc GROUP BY 1, 2),
m AS (SELECT sc.*, {_AT('timestamp_start')} AS s, greatest(0.0, date_diff('microsecond', {_AT('timestamp_start')}, {_AT('timestamp_end')}) / 6e7) AS minutes, {_AT('timestamp_end')} AS e, list_filter(string_split(stage_signal_mask, '|'), lambda x: x <> '') AS st,
  attachment_count > 0 OR prompt_artifact_reference_count >= 2 OR list_has_any(string_split(context_mode_mask, '|'), ['bounded_package', 'multi_source_synthesis', 'standards_constraints', 'examples_templates']) AS front FROM sc)
SELECT episode_id, {_TOKEN('EP', 'episode_id', EPISODE_SALT)} AS episode_token, station_id, provider, CASE WHEN s IS NOT NULL THEN substr(timestamp_start, 1, 7) END AS month, origin_candidate, automated_disposition, publication_exclusion_candidate,
CASE WHEN front THEN 'yes' ELSE 'no' END AS frontloaded_context_candidate, coalesce(array_to_string(list_sort(st), '|'), '') AS stage_signal_mask, CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN minutes END AS duration_min, completed_substantive_action_calls AS completed_substantive_actions,
CASE WHEN s IS NOT NULL AND e IS NOT NULL AND completed_substantive_action_calls > 0 THEN minutes / completed_substantive_action_calls END AS min_per_action, CAST(coalesce(verified, false) AS INT) AS verification_successful,
CAST(list_contains(st, 'audit') AS INT) AS audit_signal, CAST(list_contains(st, 'remediation') AS INT) AS remediation_signal, CAST(list_contains(st, 'packaging_release') AS INT) AS packaging_release_signal, CAST(len(st) >= 2 AS INT) AS multistage_signal,
CAST(grounded_decision_trace = 'yes' AS INT) AS grounded_decision_trace FROM m LEFT JOIN v USING (source_ref, source_line_start)""")
def episode_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.transformed(t._screened(spark, sf_dir))


#: Path and opening of the files that documents are put in, by number.
FILES = (
    ("data/x{d}.csv", "episode_id,metric\n"), ("Raw/x{d}.md", ""), ("a/PROMPTS/x{d}.txt", ""), ("a/x{d}.local.csv", 'metric,"session_ref",mapping_id\n'), ("bin/x{d}.exe", ""), ("l{d}/LICENSE", ""),
    ("cfg/x{d}.json", None), ("cfg/y{d}.json", "text "), ("b{d}/balanced_strata.csv", "metric\n"), ("docs/x{d}.md", "see prompt_text "), ("docs/x{d}.yml", "see prompt_text "), ("x{d}/.gitignore", ""),
)
NESTED = '{"a":[{"session_ref":1}],"mapping_id":2}'
_FIELDS = "|".join(boundary.ROW_LEVEL_FIELDS)
_CASE = lambda values: "CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
_QUOTE = lambda x: "'" + x.replace("'", "''") + "'"


@query("boundary_findings", f"""WITH f AS (SELECT doc_id % 12 AS k, replace({_CASE([_QUOTE(p) for p, _ in FILES])}, '{{d}}', CAST(doc_id AS VARCHAR)) AS path, {_CASE([_QUOTE(NESTED) if o is None else _QUOTE(o) + " || coalesce(text, '')" for _, o in FILES])} AS body FROM documents)
SELECT path, 'forbidden folder' AS finding FROM f WHERE k IN (1, 2) UNION ALL SELECT path, 'forbidden file' FROM f WHERE k IN (3, 8) UNION ALL SELECT path, 'unapproved file type' FROM f WHERE k = 4
UNION ALL SELECT path, 'row-level columns episode_id' FROM f WHERE k = 0 UNION ALL SELECT path, 'row-level columns mapping_id, session_ref' FROM f WHERE k = 3
UNION ALL SELECT path, 'invalid JSON' FROM f WHERE k = 7 UNION ALL SELECT path, 'row-level JSON keys mapping_id, session_ref' FROM f WHERE k = 6
UNION ALL SELECT path, 'possible row-level field name' FROM f WHERE k NOT IN (1, 4, 9) AND regexp_matches(body, '{_FIELDS}')
""" + "".join(f" UNION ALL SELECT path, '{name}' FROM f WHERE k <> 4 AND regexp_matches(body, '{p}')" for name, p in boundary.PATTERNS.items()))
def boundary_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.get(F.array(*values), (F.col("doc_id") % len(FILES)).cast("int"))
    path = F.replace(pick([F.lit(p) for p, _ in FILES]), F.lit("{d}"), F.col("doc_id").cast("string"))
    text = F.coalesce("text", F.lit(""))
    body = pick([F.lit(NESTED) if o is None else F.concat(F.lit(o), text) for _, o in FILES])
    return boundary.file_findings(table(spark, sf_dir, "documents").select(path.alias("path"), body.alias("text")))


# Violations are planted by id, so that every check has something to find.
_PLANTED_SQL = c.BALANCE_SQL.rstrip() + """,
bl AS (SELECT pr.analysis_set, pr.station_id || '|' || pr.provider || '|' || pr.month || '|' || pr.rank AS link, 'ce' AS arm, ep.* FROM pr JOIN ep ON ep.episode_id = ce_id UNION ALL
       SELECT pr.analysis_set, pr.station_id || '|' || pr.provider || '|' || pr.month || '|' || pr.rank, 'comparison', ep.* FROM pr JOIN ep ON ep.episode_id = comparison_id),
vi AS (SELECT * REPLACE (CASE WHEN episode_id % 97 = 0 THEN 'ce' ELSE arm END AS arm, CASE WHEN episode_id % 101 = 0 THEN '1999-01' ELSE month END AS month, CASE WHEN episode_id % 107 = 0 THEN 0 ELSE actions END AS actions,
         CASE WHEN episode_id % 89 = 0 THEN min_per_action + 1 ELSE min_per_action END AS min_per_action, CASE WHEN episode_id % 83 = 0 THEN 1 - multistage_signal ELSE multistage_signal END AS multistage_signal,
         CASE WHEN episode_id % 79 = 0 THEN false ELSE frontloaded END AS frontloaded) FROM bl WHERE episode_id % 103 <> 0),
gr AS (SELECT analysis_set, link, count(*) AS n, count(*) FILTER (WHERE arm = 'ce') AS ce, count(DISTINCT month) AS months FROM vi GROUP BY 1, 2)
"""


@query("planted_link_violations", _PLANTED_SQL + """SELECT 'two rows a link' AS "check", count(*) FILTER (WHERE n <> 2) AS violations FROM gr UNION ALL SELECT 'one row an arm', count(*) FILTER (WHERE ce <> 1) FROM gr UNION ALL SELECT 'one stratum a link', count(*) FILTER (WHERE months > 1) FROM gr
UNION ALL SELECT 'actions above 0', count(*) FILTER (WHERE actions <= 0) FROM vi UNION ALL SELECT 'minutes per action', count(*) FILTER (WHERE abs(min_per_action - duration_min / nullif(actions, 0)) > 1e-12) FROM vi
UNION ALL SELECT 'multistage agrees', count(*) FILTER (WHERE (multistage_signal = 1) <> (audit_signal + remediation_signal + packaging_release_signal >= 2)) FROM vi
UNION ALL SELECT 'primary context rows frontloaded', count(*) FILTER (WHERE analysis_set = 'primary_frontloaded' AND arm = 'ce' AND NOT frontloaded) FROM vi""")
def planted_link_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda n: F.col("episode_id") % n == 0
    rows = c._balanced(spark, sf_dir).filter(~by(103)).withColumns({
        "arm": F.when(by(97), "ce").otherwise(F.col("arm")),
        "month": F.when(by(101), "1999-01").otherwise(F.col("month")),
        "actions": F.when(by(107), 0).otherwise(F.col("actions")),
        "min_per_action": F.when(by(89), F.col("min_per_action") + 1).otherwise(F.col("min_per_action")),
        "multistage_signal": F.when(by(83), 1 - F.col("multistage_signal")).otherwise(F.col("multistage_signal")),
        "frontloaded": F.when(by(79), False).otherwise(F.col("frontloaded")),
    })
    return checks.link_invariants(spool(rows, "planted"))


@query("planted_bin_violations", c.BALANCE_SQL.rstrip() + "," + c.BINS_SQL + """, v AS (SELECT *, CASE WHEN action_bin = '3-5' THEN ce_rate + 0.25 ELSE ce_rate END AS x, CASE WHEN action_bin = '1-2' THEN comparison_rate / 2 - 0.25 ELSE comparison_rate END AS y, CASE WHEN analysis_set = 'unrestricted' THEN comparison_weight * 2 ELSE comparison_weight END AS w FROM bw)
SELECT 'weights sum to 1' AS "check", (SELECT count(*) FROM (SELECT analysis_set FROM v GROUP BY 1 HAVING abs(sum(w) - 1) > 1e-12)) AS violations UNION ALL SELECT 'context rate', count(*) FILTER (WHERE abs(x - ce_k / nullif(ce_n, 0)) > 1e-12) FROM v
UNION ALL SELECT 'comparison rate', count(*) FILTER (WHERE abs(y - comparison_k / nullif(comparison_n, 0)) > 1e-12) FROM v""")
def planted_bin_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = c._bins(spark, sf_dir).withColumns({
        "ce_rate": F.when(F.col("action_bin") == "3-5", F.col("ce_rate") + 0.25).otherwise(F.col("ce_rate")),
        "comparison_rate": F.when(F.col("action_bin") == "1-2", F.col("comparison_rate") / 2 - 0.25).otherwise(F.col("comparison_rate")),
        "comparison_weight": F.when(F.col("analysis_set") == "unrestricted", F.col("comparison_weight") * 2).otherwise(F.col("comparison_weight")),
    })
    return checks.bin_checks(spool(bins, "planted"), ["analysis_set"])


@query("planted_strata_disagreements", c.BALANCE_SQL + """, s AS (SELECT station_id, provider, month, count(*) FILTER (WHERE cohort = 'CE_ORDERED_ACTION') AS ce, count(*) FILTER (WHERE cohort <> 'CE_ORDERED_ACTION') AS other FROM co GROUP BY ALL)
SELECT station_id, provider, month FROM s WHERE ce > 0 AND other > 0 AND (station_id = 'ST01' OR provider = 'P0' AND substr(month, 6) = '03')""".replace("\n, s AS", ", s AS"))
def planted_strata_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata of one station claim a pair too many, and those of one provider's Marches are missing from the table."""
    rows = c._cohorts(spark, sf_dir)
    strata = cohort.strata(*cohort.arms(rows, False)).withColumn("balanced_per_condition", F.col("balanced_per_condition") + F.when(F.col("station_id") == "ST01", 1).otherwise(0))
    strata = strata.filter("NOT (provider = 'P0' AND substr(month, 6) = '03')")
    return checks.strata_agree(cohort.both_sets(rows), strata, "unrestricted").select(*cohort.STRATUM)


@query("reaggregation_differences", c.BALANCE_SQL + f""", p AS ({c._effects_sql("analysis_set")})
SELECT analysis_set, metric FROM p WHERE metric = 'audit_signal' OR metric = 'duration_min' OR metric = 'min_per_action' AND analysis_set = 'unrestricted'""")
def reaggregation_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputed effects against published ones of which one metric is off, one is there twice and one is missing from a set."""
    own = spool(effects.arm_effects(c._balanced(spark, sf_dir), ["analysis_set"]), "effects")
    published = own.filter("NOT (metric = 'min_per_action' AND analysis_set = 'unrestricted')").withColumn("effect", F.col("effect") + F.when(F.col("metric") == "audit_signal", 0.5).otherwise(0.0))
    return checks.same_values(own, published.unionByName(published.filter("metric = 'duration_min'")), ["analysis_set", "metric"], ["ce_value", "comparison_value", "effect"])


@query("effect_dispatch", c.BALANCE_SQL + f"SELECT analysis_set, station_id, metric, round(effect, 9) AS effect FROM ({c.STATION_SQL})")
def effect_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effects again, from published values and the name of their scale."""
    rows = c._stations(spark, sf_dir)
    return rows.select("analysis_set", "station_id", "metric", F.round(effect(F.col("ce_value"), F.col("comparison_value"), F.col("effect_scale")), 9).alias("effect"))


@query("later_station_bins", c.BALANCE_SQL.rstrip() + f"""
, bn AS (SELECT CASE WHEN actions <= 2 THEN '1-2' WHEN actions <= 5 THEN '3-5' ELSE '6+' END AS action_bin, count(*) FILTER (WHERE arm = 'ce' AND verification_successful = 1) AS ce_k, count(*) FILTER (WHERE arm = 'ce') AS ce_n,
  count(*) FILTER (WHERE arm <> 'ce' AND verification_successful = 1) AS comparison_k, count(*) FILTER (WHERE arm <> 'ce') AS comparison_n FROM br WHERE analysis_set = 'primary_frontloaded' AND station_id NOT IN {c.INITIAL} GROUP BY 1)
SELECT *, round(ce_k / nullif(ce_n, 0), 9) AS ce_rate, round(comparison_k / nullif(comparison_n, 0), 9) AS comparison_rate, round(ce_k / nullif(ce_n, 0) - comparison_k / nullif(comparison_n, 0), 9) AS gap, round(comparison_n / sum(comparison_n) OVER (), 9) AS comparison_weight FROM bn""".replace("\n, bn", ", bn"))
def later_station_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c._balanced(spark, sf_dir).filter(F.col("analysis_set") == "primary_frontloaded").filter(~F.col("station_id").isin(*c.INITIAL))
    return c._rounded(effects.action_bins(rows, [], c.COARSE_BINS), "ce_rate", "comparison_rate", "gap", "comparison_weight")


@query("claim_orphans", "SELECT p_partkey AS l_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def claim_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no large line names."""
    claims = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
    return checks.orphans(claims, table(spark, sf_dir, "lineitem").filter("l_quantity > 48"), "l_partkey")


@query("row_differences", """WITH a AS (SELECT c_nationkey, c_mktsegment FROM customer), b AS (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT c_nationkey, 'NEW' FROM customer WHERE c_custkey % 10 = 3)
(SELECT *, 'before' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT *, 'after' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))""")
def row_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    segment = F.when(F.col("c_custkey") % 10 == 3, "NEW").otherwise(F.col("c_mktsegment"))
    return manifest.differing_rows(rows.select("c_nationkey", "c_mktsegment"), rows.select("c_nationkey", segment.alias("c_mktsegment")))


@query("canonical_texts", """SELECT doc_id, '{"a":{"b":[1,"' || source || '"],"y":"' || lang || '"},"z":' || doc_id || ',"é":null}' AS canonical FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL
UNION ALL SELECT doc_id, NULL FROM documents WHERE lang IS NULL OR source IS NULL""")
def canonical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('{ "z": '), F.col("doc_id").cast("string"), F.lit(', "é": null, "a": {"y": "'), F.col("lang"), F.lit('", "b": [1, "'), F.col("source"), F.lit('"]}}'))
    return table(spark, sf_dir, "documents").select("doc_id", canonical_json(raw).alias("canonical"))


@query("csv_round_trip", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 'say \"' || c_name || '\", twice' || chr(10) || c_mktsegment AS note, NULL AS missing FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "csv")
    rows = table(spark, sf_dir, "customer")
    note = F.concat(F.lit('say "'), F.col("c_name"), F.lit('", twice\n'), F.col("c_mktsegment"))
    writers.csv(rows.select("c_custkey", note.alias("note"), "c_acctbal"), path, ["c_custkey", "note", "missing"])
    return readers.csv(spark, path)


@query("manifest_round_trip", "SELECT 'd/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, sha256(coalesce(text, '')) AS sha256, row_number() OVER (ORDER BY doc_id, text) AS place FROM documents")
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a manifest written in order and read again: place is the line."""
    path = shared_folder(spark, "manifest")
    doc, text = F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last()
    # By id, not by path: the padding cuts long ids. Ranges are of short keys, since the driver samples them.
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").repartitionByRange(doc, F.substring("text", 1, 16).asc_nulls_last()).sortWithinPartitions(doc, text)
    files = rows.select(F.concat(F.lit("d/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    writers.lines(manifest.entry_lines(manifest.manifest(files)), path)
    return manifest.parse_lines(readers.placed_lines(spark, path), "place")


@query("source_specs", "SELECT 'n' || c_nationkey AS reported_ref, 'SRC-' || substr(sha256('n' || c_nationkey), 1, 20) AS source_ref, 'p' || (c_nationkey % 2) AS provider, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|') AS case_ids, max(sha256(c_name)) AS expected_sha256 FROM customer GROUP BY c_nationkey")
def source_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("source_ref"), F.concat(F.lit("p"), F.col("c_nationkey") % 2).alias("provider"), F.concat(F.lit(" "), "c_mktsegment").alias("case_id"), F.sha2(F.col("c_name").cast("binary"), 256).alias("sha256"))
    return readers.source_specs(rows).withColumn("case_ids", F.array_join("case_ids", "|"))


@query("summary_selectors", """WITH n AS (SELECT r_name, n_name, n_nationkey, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS place FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT r_name AS label, place, 'name' AS key, n_name AS value FROM n UNION ALL SELECT r_name, place, 'id', CAST(n_nationkey AS VARCHAR) FROM n UNION ALL SELECT r_name, -1, 'nations', CAST(count(*) AS VARCHAR) FROM n GROUP BY r_name""")
def summary_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.struct(x["n_name"].alias("name"), x["n_nationkey"].alias("id")))
    texts = nations.groupBy(F.col("r_name").alias("label")).agg(items.alias("s"), F.count(F.lit(1)).alias("n"))
    texts = texts.select("label", F.to_json(F.struct(F.struct(F.col("n").alias("nations")).alias("scope"), F.col("s").alias("summaries"))).alias("text"))
    cells = readers.summary_cells(texts, "$.scope").select("label", F.lit(-1).alias("place"), "key", "value")
    return readers.summary_items(texts, "$.summaries").unionByName(cells)


_KEY = "concat_ws('/', {})".format
_EQUAL = f"SELECT * FROM ({c._sign_sql(c._equal_sql(c.STATION_SQL))})"
_MINIMUM = c._sign_sql(c._equal_sql(f"SELECT analysis_set || '_min20' AS analysis_set, * EXCLUDE (analysis_set) FROM ({c.STATION_SQL}) WHERE rows_per_condition >= 20"))
_CATALOG_VIEWS = {
    "pooled": ("analysis_set, metric, effect_scale", c._effects_sql("analysis_set")),
    "station": ("analysis_set, station_id, metric, effect_scale", c.STATION_SQL),
    "archive_batch": ("analysis_set, archive_group, metric, effect_scale", f"SELECT * FROM ({c._effects_sql('analysis_set, archive_group', c.GROUPS_SQL)}) WHERE archive_group IS NOT NULL"),
    "equal_station": ("analysis_set, metric", _EQUAL),
    "minimum_station_size": ("analysis_set, metric", _MINIMUM),
    "action_count_bin": ("analysis_set, action_bin", "SELECT * FROM bw"),
    "action_count_standardized": ("analysis_set", "SELECT analysis_set, sum(ce_k) / sum(ce_n) - sum(comparison_k) / sum(comparison_n) AS raw_gap, sum(gap * comparison_weight) AS effect FROM bw GROUP BY 1"),
    "linkage_window": ('"window"', f"""SELECT w AS "window", count(*) FILTER (WHERE evidence_tier = '{linkage.HIGH}' OR evidence_tier IN ('{linkage.PROBABLE}', 'UNRESOLVED') AND minimum_link_window <= w) AS candidate_positive, count(*) FILTER (WHERE evidence_tier <> 'CLEAN_ORIGIN_CANDIDATE') AS eligible_rows FROM links, (SELECT unnest({list(linkage.WINDOWS)}) AS w) GROUP BY w"""),
    "linkage_tier": ("evidence_tier", "SELECT evidence_tier, count(*) AS effect FROM links GROUP BY 1"),
    "linkage_class": ("mapping_class", "SELECT mapping_class, count(*) AS effect FROM links GROUP BY 1"),
}
_VALUES = ("ce_value", "comparison_value", "effect", "rows_per_condition", "stations", "positive_stations", "tie_stations", "negative_stations", "descriptive_sign_p", "ce_k", "ce_n", "comparison_k", "comparison_n", "candidate_positive", "eligible_rows")


def _catalog_sql() -> str:
    parts = " UNION ALL BY NAME ".join(f"SELECT '{view}' AS view, {_KEY(keys)} AS source_record, {', '.join(f'CAST({k} AS VARCHAR) AS {k}' for k in keys.split(', '))}, * EXCLUDE ({keys}) FROM ({sql}) q{i}" for i, (view, (keys, sql)) in enumerate(_CATALOG_VIEWS.items()))
    values = ", ".join(f"round(CAST({v} AS DOUBLE), 9) AS {v}" for v in _VALUES)
    with_ = c.BALANCE_SQL.rstrip() + "," + c.BINS_SQL.rstrip() + "," + c.LINK_SQL.split(c.EPISODES_SQL)[1].lstrip().removeprefix(",")
    return with_ + f"SELECT 'AGG-' || substr(sha256(view || '|' || source_record), 1, 12) AS record_id, view, source_record, {values} FROM ({parts})"


def _views(spark: SparkSession, sf_dir: str, equal: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """All ten views; ``equal`` makes the equal-station tables from station effects."""
    rows = spool(c._balanced(spark, sf_dir), "balanced")
    group = F.when(F.col("station_id").isin(*c.INITIAL), "initial").when(F.col("station_id") != "ST03", "subsequent")
    stations = spool(effects.arm_effects(rows, ["analysis_set", "station_id"], "median_ratio"), "stations")
    bins = spool(effects.action_bins(rows, ["analysis_set"], c.BINS), "bins")
    links = spool(linkage.link(c._linkable(spark, sf_dir)), "links")
    count = F.count(F.lit(1)).alias("effect")
    return {
        "pooled": effects.arm_effects(rows, ["analysis_set"]),
        "station": stations,
        "archive_batch": effects.arm_effects(rows.withColumn("archive_group", group).filter("archive_group IS NOT NULL"), ["analysis_set", "archive_group"]),
        "equal_station": equal(stations),
        "minimum_station_size": equal(effects.at_least(stations, 20)),
        "action_count_bin": bins,
        "action_count_standardized": effects.standardized_gap(bins, ["analysis_set"]).withColumnRenamed("standardized_gap", "effect"),
        "linkage_window": linkage.window_curve(links),
        "linkage_tier": links.groupBy("evidence_tier").agg(count),
        "linkage_class": links.groupBy("mapping_class").agg(count),
    }


def _values(views: dict[str, DataFrame], *more: str) -> DataFrame:
    values = (*_VALUES, *more)
    return c._rounded(catalog(views).select("record_id", "view", "source_record", *[F.col(v).cast("double").alias(v) for v in values]), *values)


@query("catalog_views", _catalog_sql())
def catalog_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten views in one long table, with exact counts where rates have them."""
    return _values(_views(spark, sf_dir, effects.equal_station))


@query("catalog_with_intervals")
def catalog_with_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ci_low and ci_high of the equal-station views, whose seeded draws have no SQL."""
    return _values(_views(spark, sf_dir, lambda stations: resample.with_intervals(effects.equal_station(stations), stations)), "ci_low", "ci_high")
