"""Queries of the screen, the taxonomy, the catalog and the checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import token, words
from ..operators import boundary, checks, cohort, effects, linkage, manifest, rules, screen
from ..operators.catalog import catalog, dictionary
from ..operators.ranking import latest_before, running_count
from ..registry import query
from ..sources.shared import spool
from ..streaming.episodes import windowed_counts
from . import comparison as c
from .adapters import EPISODES_SQL, episodes, table

#: A small contract whose patterns mean the same to Spark and DuckDB.
STAGES = {"planning": ["(^|[ \\n])with([ .,]|$)", "(^|[ \\n])mit([ .,]|$)"], "packaging": ["licensed under", "cc by"], "secrets": ["token *=", "password"]}
MODES = {"contacts": ["@[a-z]+\\.[a-z]+"], "tables": [" \\| "], "shouting": ["!!"]}


def _contract_origin() -> dict:
    return {"continuation_wrappers": ["^the and"], "tool_generated_prompts": ["^is the"], "delegated_prompt_candidates": ["^of the"]}


def _groups_sql(groups: dict, flags: str = "is") -> tuple[str, str]:
    hit = lambda p: f"CASE WHEN regexp_matches(text, '{p}', '{flags}') THEN 1 ELSE 0 END"
    counts = {name: "(" + " + ".join(hit(p) for p in patterns) + ")" for name, patterns in groups.items()}
    names = ", ".join(f"CASE WHEN {n} > 0 THEN '{name}' END" for name, n in counts.items())
    return f"coalesce(array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), '|'), '')", " + ".join(counts.values())


_S, _M = _groups_sql(STAGES), _groups_sql(MODES)


@query("taxonomy", f"SELECT doc_id, {_S[0]} AS stage_mask, {_S[1]} AS stage_hits, {_M[0]} AS mode_mask, {_M[1]} AS mode_hits FROM documents")
def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    (stages, n), (modes, m) = rules.groups_hit(text, STAGES), rules.groups_hit(text, MODES)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(stages, "|").alias("stage_mask"), n.alias("stage_hits"), F.array_join(modes, "|").alias("mode_mask"), m.alias("mode_hits"))


@query("origin", """SELECT doc_id, CASE WHEN regexp_matches(trim(text), '^the and', 'i') THEN 'continuation_wrapper' WHEN regexp_matches(trim(text), '^is the', 'i') THEN 'tool_generated'
WHEN regexp_matches(trim(text), '^of the', 'i') THEN 'delegated_agent_prompt_candidate' WHEN starts_with(lower(ltrim(text)), 'automation:') THEN 'scheduled_automation' ELSE 'direct_or_unresolved_user_level' END AS origin FROM documents""")
def origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", rules.origin(F.col("text"), _contract_origin()).alias("origin"))


@query("prompt_sizes", "SELECT doc_id, length(text) AS prompt_chars, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS prompt_words, 'PR-' || substr(sha256(text), 1, 20) AS prompt_ref FROM documents")
def prompt_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text).alias("prompt_chars"), words(text).alias("prompt_words"), token("PR", text).alias("prompt_ref"))


TOOLS = ("Bash", "Read", "Edit", "Grep", "RunLint", "TaskUpdate", "SpawnAgent", "Exec", "Click", "Other", "WebFetch", "Shell")
COMMANDS = ("ls x", "rg x", "touch y", "pytest -q", "make")


@query("tool_class", f"""WITH t AS (SELECT p_partkey, {list(TOOLS)}[p_partkey % {len(TOOLS)} + 1] AS name, {list(COMMANDS)}[p_size % {len(COMMANDS)} + 1] AS cmd FROM part)
SELECT p_partkey, CASE name WHEN 'Read' THEN 'retrieve' WHEN 'WebFetch' THEN 'retrieve' WHEN 'Edit' THEN 'modify' WHEN 'Grep' THEN 'search' WHEN 'RunLint' THEN 'verify' WHEN 'TaskUpdate' THEN 'administrative'
WHEN 'SpawnAgent' THEN 'delegate' WHEN 'Click' THEN 'execute' WHEN 'Other' THEN 'other' ELSE CASE cmd WHEN 'ls x' THEN 'retrieve' WHEN 'rg x' THEN 'search' WHEN 'touch y' THEN 'modify' WHEN 'pytest -q' THEN 'verify' ELSE 'execute' END END AS tool_class FROM t""")
def tool_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (F.col(n) % len(names)).cast("int"))
    cmd = pick(COMMANDS, "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", rules.tool_class(pick(TOOLS, "p_partkey"), cmd, cmd).alias("tool_class"))


@query("episode_segmentation", """WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS episode FROM conversations)
SELECT conv_id, CAST(episode AS BIGINT) AS episode, min(turn) AS turn_start, max(turn) AS turn_end, count(*) AS n_turns, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS assistant_chars FROM s WHERE episode > 0 GROUP BY 1, 2""")
def episode_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("chars"))
    user = F.col("role") == "user"
    seen = latest_before(rows, ["conv_id"], ["turn"], user, [], "opened", 1000)
    seen = seen.withColumn("start", F.when(user, F.col("turn")).otherwise(F.col("opened.turn"))).filter("start IS NOT NULL")
    body = seen.groupBy("conv_id", "start").agg(F.max("turn").alias("turn_end"), F.count(F.lit(1)).alias("n_turns"), F.sum(F.when(F.col("role") == "assistant", F.col("chars")).otherwise(0)).cast("long").alias("assistant_chars"))
    return running_count(body, ["conv_id"], "start", "episode", 1000).select("conv_id", "episode", F.col("start").alias("turn_start"), "turn_end", "n_turns", "assistant_chars")


@query("prompt_reuse", "SELECT conv_id, turn, 'PR-' || substr(sha256(text), 1, 20) AS prompt_ref, count(*) OVER (PARTITION BY text) AS prompt_reuse_count FROM conversations WHERE role = 'user'")
def prompt_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", token("PR", F.col("text")).alias("prompt_ref"))
    return rows.join(rows.groupBy("prompt_ref").agg(F.count(F.lit(1)).alias("prompt_reuse_count")), "prompt_ref").select("conv_id", "turn", "prompt_ref", "prompt_reuse_count")


@query("tool_result_pairing", """WITH e AS (SELECT event_id, user_id, event_id % 3 = 0 AS is_call, event_id % 3 = 1 AS is_result, value > 50 AS ok FROM events WHERE event_id % 3 < 2),
m AS (SELECT *, max(CASE WHEN is_call THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS call FROM e),
d AS (SELECT call, arg_max(ok, event_id) AS succeeded, count(*) AS results FROM m WHERE is_result AND call IS NOT NULL GROUP BY call)
SELECT event_id AS call_id, user_id, d.call IS NOT NULL AS completed, coalesce(succeeded, false) AS succeeded, coalesce(results, 0) AS results FROM e LEFT JOIN d ON d.call = event_id WHERE is_call""")
def tool_result_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 3
    rows = table(spark, sf_dir, "events").filter(kind < 2).select("event_id", "user_id", (kind == 0).alias("is_call"), (F.col("value") > 50).alias("ok"))
    seen = latest_before(rows, ["user_id"], ["event_id"], F.col("is_call"), [], "call", 100_000)
    done = seen.filter("NOT is_call AND call IS NOT NULL").groupBy(F.col("call.event_id").alias("call_id")).agg(F.max_by("ok", "event_id").alias("s"), F.count(F.lit(1)).alias("n"))
    calls = rows.filter("is_call").select(F.col("event_id").alias("call_id"), "user_id").join(done, "call_id", "left")
    return calls.select("call_id", "user_id", F.col("n").isNotNull().alias("completed"), F.coalesce("s", F.lit(False)).alias("succeeded"), F.coalesce("n", F.lit(0)).alias("results"))


@query("cutoff_filter", """SELECT event_type, count(*) FILTER (WHERE ts > (SELECT min(ts) + INTERVAL 10 DAY FROM events)) AS excluded, count(*) FILTER (WHERE NOT ts > (SELECT min(ts) + INTERVAL 10 DAY FROM events)) AS kept FROM events GROUP BY 1""")
def cutoff_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    cutoff = events.agg((F.min("ts") + F.expr("INTERVAL 10 DAYS")).alias("cutoff"))
    late = F.col("ts") > F.col("cutoff")
    return events.crossJoin(F.broadcast(cutoff)).groupBy("event_type").agg(F.count_if(late).alias("excluded"), F.count_if(~late).alias("kept"))  # cutoff: one row


@query("disposition_rollup", "WITH " + EPISODES_SQL + "SELECT station_id, coalesce(provider, 'ALL') AS provider, disposition, count(*) AS episodes FROM ep GROUP BY GROUPING SETS ((station_id, provider, disposition), (station_id, disposition))")
def disposition_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.disposition_rollup(episodes(spark, sf_dir), "disposition")


@query("run_receipts", "WITH " + EPISODES_SQL + """SELECT station_id, count(*) AS episodes, count(DISTINCT session_ref) AS sources, count(DISTINCT month) AS distinct_prompts, count(*) FILTER (WHERE disposition = 'candidate_strong') AS strong,
count(*) FILTER (WHERE disposition = 'candidate_probable') AS probable, count(*) FILTER (WHERE calls > 1) AS reused FROM ep GROUP BY 1""")
def run_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.run_receipts(episodes(spark, sf_dir).select("station_id", F.col("session_ref").alias("source_ref"), F.col("month").alias("prompt_ref"), F.col("disposition").alias("automated_disposition"), F.col("calls").alias("prompt_reuse_count")))


@query("disclosure_findings", " UNION ALL ".join(f"SELECT CAST(doc_id AS VARCHAR) AS label, '{name}' AS finding FROM documents WHERE regexp_matches(text, '{p}')" for name, p in boundary.PATTERNS.items()))
def disclosure_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.text_findings(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("label"), "text"))


@query("link_invariants", "SELECT * FROM (VALUES ('two rows a link', 0), ('one row an arm', 0), ('one stratum a link', 0), ('actions above 0', 0), ('minutes per action', 0), ('multistage agrees', 0), ('primary context rows frontloaded', 0)) v(\"check\", violations)")
def link_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.link_invariants(c._balanced(spark, sf_dir))


@query("bin_checks", "SELECT * FROM (VALUES ('weights sum to 1', 0), ('context rate', 0), ('comparison rate', 0)) v(\"check\", violations)")
def bin_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.bin_checks(c._bins(spark, sf_dir), ["analysis_set"])


@query("curve_checks", "SELECT * FROM (VALUES ('curve never falls', 0), ('unresolved', 0), ('high tier has window 0', 0)) v(\"check\", violations)")
def curve_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = linkage.link(c._linkable(spark, sf_dir))
    return checks.curve_checks(links, linkage.window_curve(links))


_KINDS = {"c_custkey": "BIGINT", "c_name": "VARCHAR", "c_nationkey": "INT", "c_acctbal": "DOUBLE", "c_mktsegment": "VARCHAR"}


@query("data_dictionary", " UNION ALL ".join(f"""SELECT 'customer' AS artifact, '{f}' AS field, CASE WHEN bool_and(lower(v) IN ('true', 'false', 'yes', 'no')) THEN 'boolean' WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]+')) THEN 'integer'
WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'number' ELSE 'string' END AS data_type, bool_or(v IS NULL OR trim(v) = '') AS nullable FROM (SELECT CAST({f} AS VARCHAR) AS v FROM customer)""" for f in _KINDS))
def data_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(table(spark, sf_dir, "customer"), "customer")


@query("aggregate_catalog", c.BALANCE_SQL + f""", p AS (SELECT analysis_set, metric, effect_scale, rows_per_condition, ce_value, comparison_value, effect FROM ({c._effects_sql("analysis_set")})),
s AS (SELECT analysis_set, station_id, metric, effect_scale, rows_per_condition, ce_value, comparison_value, effect FROM ({c.STATION_SQL})),
u AS (SELECT 'pooled' AS view, analysis_set || '/' || metric || '/' || effect_scale AS source_record, NULL AS station_id, * FROM p UNION ALL BY NAME
      SELECT 'station' AS view, analysis_set || '/' || station_id || '/' || metric || '/' || effect_scale AS source_record, * FROM s)
SELECT 'AGG-' || substr(sha256(view || '|' || source_record), 1, 12) AS record_id, view, source_record, analysis_set, station_id, metric, effect_scale, CAST(rows_per_condition AS DOUBLE) AS rows_per_condition,
round(ce_value, 9) AS ce_value, round(comparison_value, 9) AS comparison_value, round(effect, 9) AS effect FROM u""")
def aggregate_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spool(c._balanced(spark, sf_dir), "balanced")
    views = {"pooled": effects.arm_effects(rows, ["analysis_set"]), "station": effects.arm_effects(rows, ["analysis_set", "station_id"], "median_ratio")}
    return c._rounded(catalog(views), *c.VALUES)


@query("manifest_diff", """WITH e AS (SELECT 'd' || doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0), a AS (SELECT 'd' || doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 0)
SELECT path, CASE WHEN a.h IS NULL THEN 'missing' WHEN e.h IS NULL THEN 'unlisted' ELSE 'changed' END AS status FROM e FULL JOIN a USING (path) WHERE e.h IS DISTINCT FROM a.h""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("d"), "doc_id").alias("path")
    expected = docs.filter("doc_id % 11 <> 0").select(path, F.col("text").cast("binary").alias("content"))
    actual = docs.filter("doc_id % 13 <> 0").select(path, F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary").alias("content"))
    return manifest.difference(manifest.manifest(expected), manifest.manifest(actual))


@query("last_ce_asof", c.LINK_SQL + "SELECT row_id, session_ref, turn, last_turn, adjacent FROM pv WHERE eligible")
def last_ce_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c._linkable(spark, sf_dir)
    acted = F.col("actions") > 0
    rows = rows.select("row_id", "session_ref", "turn", (acted & F.col("disposition").isin(*linkage.CE_DISPOSITIONS)).alias("is_ce"), (acted & (F.col("disposition") == linkage.COMPARISON_DISPOSITION)).alias("eligible"))
    seen = latest_before(rows, ["session_ref"], ["turn"], F.lit(True), ["is_ce"], "previous", 1000)
    seen = latest_before(seen, ["session_ref"], ["turn"], F.col("is_ce"), [], "last", 1000).filter("eligible")
    return seen.select("row_id", "session_ref", "turn", F.col("last.turn").alias("last_turn"), F.coalesce(F.col("previous.is_ce"), F.lit(False)).alias("adjacent"))


@query("shared_target_prior", c.LINK_SQL + "SELECT row_id, kind, shared, t AS latest_turn FROM sh WHERE kind = 't'")
def shared_target_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c._linkable(spark, sf_dir)
    acted = F.col("actions") > 0
    keys = rows.select("row_id", "session_ref", "turn", (acted & F.col("disposition").isin(*linkage.CE_DISPOSITIONS)).alias("is_ce"), (acted & (F.col("disposition") == linkage.COMPARISON_DISPOSITION)).alias("eligible"), F.explode("targets").alias("key"))
    found = latest_before(keys, ["session_ref", "key"], ["turn"], F.col("is_ce"), [], "hit", 1000).filter("eligible AND hit IS NOT NULL")
    return found.groupBy("row_id").agg(F.lit("t").alias("kind"), F.count(F.lit(1)).alias("shared"), F.max("hit.turn").alias("latest_turn"))


@query("label_effects", """WITH r AS (SELECT lang, toxic, quality, n_chars FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) FILTER (WHERE toxic = 1) AS n_toxic, count(*) FILTER (WHERE toxic = 0) AS n_clean, round(avg(quality) FILTER (WHERE toxic = 1) - avg(quality) FILTER (WHERE toxic = 0), 9) AS quality_difference,
round(median(n_chars) FILTER (WHERE toxic = 1) / median(n_chars) FILTER (WHERE toxic = 0), 9) AS length_ratio FROM r GROUP BY 1""")
def label_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    toxic, clean = F.col("toxic") == 1, F.col("toxic") == 0
    out = rows.groupBy("lang").agg(F.count_if(toxic).alias("n_toxic"), F.count_if(clean).alias("n_clean"), (F.avg(F.when(toxic, F.col("quality"))) - F.avg(F.when(clean, F.col("quality")))).alias("quality_difference"), (F.median(F.when(toxic, F.col("n_chars"))) / F.nullif(F.median(F.when(clean, F.col("n_chars"))), F.lit(0))).alias("length_ratio"))
    return c._rounded(out, "quality_difference", "length_ratio")


@query("strata_disagreements", "SELECT CAST(NULL AS VARCHAR) AS station_id, CAST(NULL AS VARCHAR) AS provider, CAST(NULL AS VARCHAR) AS month WHERE false")
def strata_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    ce, other = cohort.arms(c._cohorts(spark, sf_dir), False)
    return checks.strata_agree(c._balanced(spark, sf_dir), cohort.strata(ce, other), "unrestricted").select(*cohort.STRATUM)


@query("stream_event_windows", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n_events, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(spark, f"{sf_dir}/events.parquet").select(F.col("day").cast("string").alias("day"), "event_type", "n_events", F.round("total", 6).alias("total"))
