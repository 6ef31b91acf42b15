"""Queries of the balanced comparison and of the linkage over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import exact_count
from ..operators import cohort, effects, linkage, resample
from ..registry import query
from ..sources.shared import spool
from .adapters import BINARY, EPISODES_SQL, RATIO, episodes, trace, with_turns

BALANCE_SQL = (
    "WITH "
    + EPISODES_SQL
    + """,
co AS (SELECT *, CASE disposition WHEN 'candidate_strong' THEN 'CE_ORDERED_ACTION' ELSE 'ROUTED_COMPARISON_ACTION' END AS cohort
       FROM ep WHERE actions > 0 AND disposition <> 'candidate_probable'),
st AS (SELECT 'unrestricted' AS analysis_set, * FROM co UNION ALL
       SELECT 'primary_frontloaded', * FROM co WHERE frontloaded OR cohort = 'ROUTED_COMPARISON_ACTION'),
rk AS (SELECT *, row_number() OVER (PARTITION BY analysis_set, cohort, station_id, provider, month ORDER BY sha256(CAST(episode_id AS VARCHAR)), episode_id) AS rank FROM st),
pr AS (SELECT a.analysis_set, a.station_id, a.provider, a.month, a.rank, a.episode_id AS ce_id, b.episode_id AS comparison_id
       FROM rk a JOIN rk b USING (analysis_set, station_id, provider, month, rank)
       WHERE a.cohort = 'CE_ORDERED_ACTION' AND b.cohort = 'ROUTED_COMPARISON_ACTION'),
br AS (SELECT pr.analysis_set, 'ce' AS arm, ep.* FROM pr JOIN ep ON ep.episode_id = ce_id UNION ALL
       SELECT pr.analysis_set, 'comparison', ep.* FROM pr JOIN ep ON ep.episode_id = comparison_id)
"""
)


def _effects_sql(by: str, source: str = "br", ratio: str = "ratio_of_condition_medians") -> str:
    cells = [
        f"SELECT {by}, '{m}' AS metric, 'risk_difference' AS effect_scale, avg({m}) FILTER (WHERE arm = 'ce') AS ce_value, avg({m}) FILTER (WHERE arm = 'comparison') AS comparison_value, "
        f"count(*) FILTER (WHERE arm = 'ce') AS rows_per_condition, avg({m}) FILTER (WHERE arm = 'ce') - avg({m}) FILTER (WHERE arm = 'comparison') AS effect FROM {source} GROUP BY ALL"
        for m in BINARY
    ] + [
        f"SELECT {by}, '{m}', '{ratio}', median({m}) FILTER (WHERE arm = 'ce'), median({m}) FILTER (WHERE arm = 'comparison'), count(*) FILTER (WHERE arm = 'ce'), "
        f"CASE WHEN median({m}) FILTER (WHERE arm = 'comparison') > 0 THEN median({m}) FILTER (WHERE arm = 'ce') / median({m}) FILTER (WHERE arm = 'comparison') END FROM {source} GROUP BY ALL"
        for m in RATIO
    ]
    return "\nUNION ALL\n".join(cells)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles depend on their order: results are stated to 9 decimals."""
    return df.select(*[F.round(c, 9).alias(c) if c in columns else F.col(c) for c in df.columns])


def _round_sql(columns: str, rounded: str, body: str) -> str:
    return f"SELECT {columns}, " + ", ".join(f"round({c}, 9) AS {c}" for c in rounded.split(", ")) + f" FROM ({body})"


VALUES = ("ce_value", "comparison_value", "effect")
VALUES_SQL = "ce_value, comparison_value, effect"


def _cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both arms, computed once: the plans below read them several times."""
    return spool(cohort.cohorts(episodes(spark, sf_dir)), "cohorts")


def _balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.both_sets(_cohorts(spark, sf_dir))


@query("balanced_pairs", BALANCE_SQL + "SELECT analysis_set, station_id, provider, month, rank, ce_id, comparison_id FROM pr")
def balanced_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cohorts(spark, sf_dir)
    sets = [cohort.balance(*cohort.arms(rows, primary)).withColumn("analysis_set", F.lit(name)) for name, primary in (("unrestricted", False), ("primary_frontloaded", True))]
    return sets[0].unionByName(sets[1]).select("analysis_set", *cohort.STRATUM, "rank", "ce_id", "comparison_id")


@query("sample_links", BALANCE_SQL + "SELECT ce_id, comparison_id, 'LINK-' || substr(sha256('(''' || station_id || ''', ''' || provider || ''', ''' || month || ''')|' || rank), 1, 16) AS sample_link_id FROM pr WHERE analysis_set = 'unrestricted'")
def sample_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cohorts(spark, sf_dir)
    return cohort.balance(*cohort.arms(rows, False)).select("ce_id", "comparison_id", "sample_link_id")


@query("balanced_strata", BALANCE_SQL + """SELECT station_id, provider, month, count(*) FILTER (WHERE cohort = 'CE_ORDERED_ACTION') AS ce_available, count(*) FILTER (WHERE cohort <> 'CE_ORDERED_ACTION') AS comparison_available,
least(count(*) FILTER (WHERE cohort = 'CE_ORDERED_ACTION'), count(*) FILTER (WHERE cohort <> 'CE_ORDERED_ACTION')) AS balanced_per_condition
FROM co GROUP BY ALL HAVING count(DISTINCT cohort) = 2""")
def balanced_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.strata(*cohort.arms(_cohorts(spark, sf_dir), False))


@query("cohort_counts", "WITH " + EPISODES_SQL + """SELECT CASE disposition WHEN 'candidate_strong' THEN 'CE_ORDERED_ACTION' ELSE 'ROUTED_COMPARISON_ACTION' END AS cohort, count(*) AS n_rows,
count(DISTINCT station_id) AS stations, count(DISTINCT session_ref) AS sessions, count(*) FILTER (WHERE frontloaded) AS frontloaded_rows
FROM ep WHERE actions > 0 AND disposition <> 'candidate_probable' GROUP BY 1""")
def cohort_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohort.cohorts(episodes(spark, sf_dir))
    return rows.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("station_id").alias("stations"), F.count_distinct("session_ref").alias("sessions"), F.count_if("frontloaded").alias("frontloaded_rows"))


@query("pooled_summary", BALANCE_SQL + _round_sql("analysis_set, metric, effect_scale, rows_per_condition", VALUES_SQL, _effects_sql("analysis_set")))
def pooled_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(effects.arm_effects(_balanced(spark, sf_dir), ["analysis_set"]), *VALUES)


STATION_SQL = _effects_sql("analysis_set, station_id", ratio="median_ratio")


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects.arm_effects(_balanced(spark, sf_dir), ["analysis_set", "station_id"], "median_ratio", strict=True)


@query("station_effects", BALANCE_SQL + _round_sql("analysis_set, station_id, metric, effect_scale, rows_per_condition", VALUES_SQL, STATION_SQL))
def station_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_stations(spark, sf_dir), *VALUES)


GROUPS_SQL = "(SELECT *, CASE WHEN station_id IN ('ST00', 'ST01', 'ST02') THEN 'initial' WHEN station_id <> 'ST03' THEN 'subsequent' END AS archive_group FROM br)"


@query("archive_group_summary", BALANCE_SQL + _round_sql("analysis_set, archive_group, metric, effect_scale, rows_per_condition, contributing_stations", VALUES_SQL, f"SELECT * FROM ({_effects_sql('analysis_set, archive_group', GROUPS_SQL)}) JOIN (SELECT analysis_set, archive_group, count(DISTINCT station_id) AS contributing_stations FROM {GROUPS_SQL} GROUP BY ALL) USING (analysis_set, archive_group)"))
def archive_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.when(F.col("station_id").isin("ST00", "ST01", "ST02"), "initial").when(F.col("station_id") != "ST03", "subsequent")
    rows = _balanced(spark, sf_dir).withColumn("archive_group", group).filter("archive_group IS NOT NULL")
    return _rounded(effects.arm_effects(rows, ["analysis_set", "archive_group"], stations=True), *VALUES)


def _equal_sql(source: str) -> str:
    return f"""SELECT analysis_set, metric, count(*) AS stations,
  round(CASE WHEN bool_and(effect_scale = 'risk_difference') THEN avg(effect) ELSE exp(avg(CASE WHEN effect > 0 THEN ln(effect) END)) END, 9) AS effect,
  count(*) FILTER (WHERE effect - none > 1e-12) AS positive_stations, count(*) FILTER (WHERE abs(effect - none) <= 1e-12) AS tie_stations, count(*) FILTER (WHERE effect - none < -1e-12) AS negative_stations
FROM (SELECT *, CASE WHEN effect_scale = 'risk_difference' THEN 0 ELSE 1 END AS none FROM ({source})) WHERE effect_scale = 'risk_difference' AND effect IS NOT NULL OR effect > 0 GROUP BY ALL"""


def _sign_sql(source: str) -> str:
    return f"""SELECT q.*, CASE WHEN positive_stations + negative_stations > 0 THEN round(least(1.0, 2 * (SELECT sum(factorial(CAST(positive_stations + negative_stations AS INT))::DOUBLE / (factorial(CAST(i AS INT))::DOUBLE * factorial(CAST(positive_stations + negative_stations - i AS INT))::DOUBLE))
  FROM (SELECT unnest(range(0, least(positive_stations, negative_stations) + 1)) AS i)) / pow(2.0, positive_stations + negative_stations)), 9) END AS descriptive_sign_p FROM ({source}) q"""


@query("equal_station_summary", BALANCE_SQL + _sign_sql(_equal_sql(STATION_SQL)))
def equal_station_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(effects.equal_station(_stations(spark, sf_dir)), "effect", "descriptive_sign_p")


@query("min_station_summary", BALANCE_SQL + _sign_sql(_equal_sql(f"SELECT analysis_set || '_min20' AS analysis_set, * EXCLUDE (analysis_set) FROM ({STATION_SQL}) WHERE rows_per_condition >= 20")))
def min_station_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(effects.equal_station(effects.at_least(_stations(spark, sf_dir), 20)), "effect", "descriptive_sign_p")


@query("equal_station_intervals")
def equal_station_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The equal-station and minimum-size tables with their bootstrap intervals, whose seeded draws have no SQL."""
    rows = _stations(spark, sf_dir)
    stations = spool(rows.unionByName(effects.at_least(rows, 20)), "stations")
    return resample.with_intervals(effects.equal_station(stations), stations)


# Bins of actions, and the coarse ones of the later stations.
BINS = (("1-2", 1, 2), ("3-5", 3, 5), ("6-10", 6, 10), ("11+", 11, None))
COARSE_BINS = (("1-2", 1, 2), ("3-5", 3, 5), ("6+", 6, None))
INITIAL = ("ST00", "ST01", "ST02")
BINS_SQL = """
bn AS (SELECT analysis_set, CASE WHEN actions <= 2 THEN '1-2' WHEN actions <= 5 THEN '3-5' WHEN actions <= 10 THEN '6-10' ELSE '11+' END AS action_bin,
  count(*) FILTER (WHERE arm = 'ce' AND verification_successful = 1) AS ce_k, count(*) FILTER (WHERE arm = 'ce') AS ce_n,
  count(*) FILTER (WHERE arm <> 'ce' AND verification_successful = 1) AS comparison_k, count(*) FILTER (WHERE arm <> 'ce') AS comparison_n FROM br GROUP BY ALL),
bw AS (SELECT *, ce_k / nullif(ce_n, 0) AS ce_rate, comparison_k / nullif(comparison_n, 0) AS comparison_rate, ce_k / nullif(ce_n, 0) - comparison_k / nullif(comparison_n, 0) AS gap,
  comparison_n / sum(comparison_n) OVER (PARTITION BY analysis_set) AS comparison_weight FROM bn)
"""


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects.action_bins(_balanced(spark, sf_dir), ["analysis_set"], BINS)


@query("action_bins", BALANCE_SQL.rstrip() + "," + BINS_SQL + "SELECT analysis_set, action_bin, ce_k, ce_n, comparison_k, comparison_n, round(ce_rate, 9) AS ce_rate, round(comparison_rate, 9) AS comparison_rate, round(gap, 9) AS gap, round(comparison_weight, 9) AS comparison_weight FROM bw")
def action_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_bins(spark, sf_dir), "ce_rate", "comparison_rate", "gap", "comparison_weight")


@query("standardized_gap", BALANCE_SQL.rstrip() + "," + BINS_SQL + "SELECT analysis_set, round(sum(ce_k) / sum(ce_n) - sum(comparison_k) / sum(comparison_n), 9) AS raw_gap, round(sum(gap * comparison_weight), 9) AS standardized_gap FROM bw GROUP BY 1")
def standardized_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(effects.standardized_gap(_bins(spark, sf_dir), ["analysis_set"]), "raw_gap", "standardized_gap")


@query("exact_numerators", BALANCE_SQL + "SELECT analysis_set, station_id, metric, CAST(round(ce_value * rows_per_condition) AS BIGINT) AS ce_k, CAST(round(comparison_value * rows_per_condition) AS BIGINT) AS comparison_k, rows_per_condition FROM (" + STATION_SQL + ") WHERE effect_scale = 'risk_difference'")
def exact_numerators(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("rows_per_condition")
    rows = _stations(spark, sf_dir).filter("effect_scale = 'risk_difference'")
    return rows.select("analysis_set", "station_id", "metric", exact_count(F.col("ce_value"), n).alias("ce_k"), exact_count(F.col("comparison_value"), n).alias("comparison_k"), "rows_per_condition")


@query("bootstrap_ci_exact")
def bootstrap_ci_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.exact_bootstrap(_stations(spark, sf_dir))


@query("bootstrap_ci_native", BALANCE_SQL + f"""SELECT analysis_set, metric, round(CASE WHEN ratio THEN exp(l) ELSE l END, 9) AS ci_low, round(CASE WHEN ratio THEN exp(h) ELSE h END, 9) AS ci_high FROM (
SELECT analysis_set, metric, bool_or(ratio) AS ratio, quantile_cont(m, 0.025) AS l, quantile_cont(m, 0.975) AS h FROM (
  SELECT analysis_set, metric, r, any_value(ratio) AS ratio, avg(s[CAST(('0x' || substr(md5(r || ':' || d), 1, 8))::BIGINT % len(s) AS INT) + 1]) AS m FROM (
    SELECT *, unnest(range(1, len(s) + 1)) AS d FROM (SELECT *, unnest(range(1, 201)) AS r FROM (
      SELECT analysis_set, metric, bool_or(effect_scale <> 'risk_difference') AS ratio, list(CASE WHEN effect_scale = 'risk_difference' THEN effect ELSE ln(effect) END ORDER BY station_id) AS s
      FROM ({STATION_SQL}) WHERE effect_scale = 'risk_difference' AND effect IS NOT NULL OR effect > 0 GROUP BY ALL))) GROUP BY analysis_set, metric, r)
GROUP BY analysis_set, metric)""")
def bootstrap_ci_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(resample.native_bootstrap(_stations(spark, sf_dir), 200), "ci_low", "ci_high")


def _linkable(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("completed") & F.col("succeeded")
    keys = trace(spark, sf_dir).groupBy("ok").agg(F.collect_set(F.when(done, F.col("target"))).alias("targets"), F.collect_set(F.when(F.col("class") == "retrieve", F.col("anchor"))).alias("anchors"))
    narrow = episodes(spark, sf_dir).select("episode_id", "session_ref", "station_id", "provider", "started", "actions", "disposition", "calls", "cue")
    ep = with_turns(narrow).join(keys, F.col("episode_id") == F.col("ok"))
    words = F.when(F.col("calls") <= 3, 10).otherwise(100)
    rows = ep.select(F.col("episode_id").alias("row_id"), "session_ref", "station_id", "provider", F.col("turn").cast("long").alias("turn"), F.lit(0).alias("line"), "actions", "disposition", words.alias("words"), "cue", "targets", "anchors")
    return spool(rows, "linkable")


LINK_SQL = (
    "WITH "
    + EPISODES_SQL
    + """,
r AS (SELECT episode_id AS row_id, session_ref, turn, actions, disposition, CASE WHEN calls <= 3 THEN 10 ELSE 100 END AS words, cue,
  actions > 0 AND disposition IN ('candidate_strong', 'candidate_probable') AS is_ce, actions > 0 AND disposition = 'exclude_no_context_operation' AS eligible FROM ep),
k AS (SELECT DISTINCT ok AS row_id, 't' AS kind, target AS key FROM tr WHERE completed AND succeeded UNION SELECT DISTINCT ok, 'a', anchor FROM tr WHERE class = 'retrieve'),
sh AS (SELECT a.row_id, ka.kind, count(DISTINCT ka.key) AS shared, max(b.turn) AS t FROM r a JOIN k ka USING (row_id)
       JOIN r b ON b.session_ref = a.session_ref AND b.turn < a.turn AND b.is_ce JOIN k kb ON kb.row_id = b.row_id AND kb.kind = ka.kind AND kb.key = ka.key
       WHERE a.eligible GROUP BY 1, 2),
pv AS (SELECT *, coalesce(lag(is_ce) OVER w, false) AS adjacent, max(CASE WHEN is_ce THEN turn END) OVER (PARTITION BY session_ref ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_turn
       FROM r WINDOW w AS (PARTITION BY session_ref ORDER BY turn)),
j AS (SELECT pv.*, coalesce(st.shared, 0) AS shared_targets, coalesce(sa.shared, 0) AS shared_anchors, turn - last_turn AS d,
        coalesce(greatest(st.t, sa.t), last_turn) AS m_turn
      FROM pv LEFT JOIN sh st ON st.row_id = pv.row_id AND st.kind = 't' LEFT JOIN sh sa ON sa.row_id = pv.row_id AND sa.kind = 'a' WHERE eligible),
l AS (SELECT j.row_id, j.session_ref, j.turn, p.row_id AS matched_prior_ce, d AS turn_distance, shared_targets, shared_anchors, j.cue,
  CASE WHEN last_turn IS NULL THEN 'CLEAN_ORIGIN_CANDIDATE' WHEN shared_targets > 0 THEN 'EXACT_SUCCESSFUL_TOOL_TARGET' WHEN shared_anchors > 0 THEN 'EXACT_PROMPT_ANCHOR'
    WHEN adjacent AND j.words <= 30 AND j.cue THEN 'IMMEDIATE_SHORT_REFERENCE' WHEN adjacent THEN 'IMMEDIATE_ADJACENCY' WHEN j.cue AND d <= 20 THEN 'CONTEXT_REFERENCE_WITHIN_20'
    WHEN d <= 3 THEN 'NEAR_SEQUENCE' ELSE 'UNRESOLVED_PRIOR_CE_SESSION' END AS mapping_class
  FROM j LEFT JOIN r p ON p.session_ref = j.session_ref AND p.turn = j.m_turn),
links AS (SELECT *, CASE WHEN mapping_class = 'CLEAN_ORIGIN_CANDIDATE' THEN mapping_class WHEN mapping_class IN ('EXACT_SUCCESSFUL_TOOL_TARGET', 'EXACT_PROMPT_ANCHOR', 'IMMEDIATE_SHORT_REFERENCE') THEN 'HIGH_CONFIDENCE_CANDIDATE'
    WHEN mapping_class = 'UNRESOLVED_PRIOR_CE_SESSION' THEN 'UNRESOLVED' ELSE 'PROBABLE_CANDIDATE' END AS evidence_tier,
  CASE WHEN mapping_class = 'CLEAN_ORIGIN_CANDIDATE' THEN NULL WHEN mapping_class IN ('EXACT_SUCCESSFUL_TOOL_TARGET', 'EXACT_PROMPT_ANCHOR', 'IMMEDIATE_SHORT_REFERENCE') THEN 0
    WHEN mapping_class = 'IMMEDIATE_ADJACENCY' THEN 1 WHEN mapping_class = 'UNRESOLVED_PRIOR_CE_SESSION' AND NOT cue THEN NULL ELSE turn_distance END AS minimum_link_window FROM l)
"""
)


@query("linkage_map", LINK_SQL + "SELECT row_id, session_ref, turn, matched_prior_ce, turn_distance, shared_targets, shared_anchors, cue, mapping_class, evidence_tier, minimum_link_window FROM links")
def linkage_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.link(_linkable(spark, sf_dir))


@query("linkage_tiers", LINK_SQL + "SELECT evidence_tier, mapping_class, count(*) AS n_rows FROM links GROUP BY ALL")
def linkage_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.link(_linkable(spark, sf_dir)).groupBy("evidence_tier", "mapping_class").agg(F.count(F.lit(1)).alias("n_rows"))


@query("linkage_window_curve", LINK_SQL + """SELECT w AS "window", count(*) FILTER (WHERE evidence_tier = 'HIGH_CONFIDENCE_CANDIDATE' OR evidence_tier IN ('PROBABLE_CANDIDATE', 'UNRESOLVED') AND minimum_link_window <= w) AS candidate_positive,
count(*) FILTER (WHERE evidence_tier <> 'CLEAN_ORIGIN_CANDIDATE') AS eligible_rows,
round(count(*) FILTER (WHERE evidence_tier = 'HIGH_CONFIDENCE_CANDIDATE' OR evidence_tier IN ('PROBABLE_CANDIDATE', 'UNRESOLVED') AND minimum_link_window <= w) / count(*) FILTER (WHERE evidence_tier <> 'CLEAN_ORIGIN_CANDIDATE'), 9) AS candidate_positive_rate,
count(*) FILTER (WHERE evidence_tier <> 'CLEAN_ORIGIN_CANDIDATE') - count(*) FILTER (WHERE evidence_tier = 'HIGH_CONFIDENCE_CANDIDATE' OR evidence_tier IN ('PROBABLE_CANDIDATE', 'UNRESOLVED') AND minimum_link_window <= w) AS unresolved
FROM links, (SELECT unnest([5, 10, 20, 50, 106]) AS w) GROUP BY w""")
def linkage_window_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(linkage.window_curve(linkage.link(_linkable(spark, sf_dir))), "candidate_positive_rate")
