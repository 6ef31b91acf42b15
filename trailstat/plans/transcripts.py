"""Raw transcripts made from the table of conversations, screened from their lines to dispositions, and the same in SQL.

A conversation is a source; even ones have messages, odd ones payloads. Each turn becomes one to four
lines of JSON. The SQL never sees the lines: it states what they hold from the columns of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import screen
from ..registry import query
from .adapters import table
from .contract import CONTRACT

CUTOFF = "2026-01-25T00:00:00+00:00"
#: What prompts open with, and how many artifacts each names.
PHRASES = (
    ("Please review the repository against the requirements in ./spec.md and ./rules.json today", 2),
    ("Fix the bug in the app and deploy it as in the earlier conversation", 0),
    ("Build the website", 0),
    ("Continue.", 0),
    ("Write the journal submission with citations", 0),
    ("Prepare the sales proposal", 0),
    ("This session is being continued from a previous conversation", 0),
    ("You are subagent 3 for the audit", 0),
    ("tool_result: done", 0),
    ("Automation: nightly validation of the package", 0),
    ("Compare these files ./x.csv ./y.csv z.txt with the examples", 3),
    ("Hello there", 0),
)
#: Name, key and value of calls, and their class; the last has no key that names a target.
CALLS = (
    ("Read", "file_path", "notes/{c}.md", "retrieve"),
    ("Grep", "pattern", "p{m}", "search"),
    ("Edit", "file_path", "src/{c}.py", "modify"),
    ("Bash", "command", "pytest -q", "verify"),
    ("Bash", "command", "ls docs", "retrieve"),
    ("TaskUpdate", "", "", "administrative"),
)


def _pick(values, n: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_ref, provider, line, raw."""
    c, t = F.col("conv_id"), F.col("turn")
    n = c + t
    text = F.coalesce("text", F.lit(""))
    stamp = F.when(n % 17 == 4, "no time").otherwise(F.concat(F.lit("2026-01-"), F.lpad((1 + n % 28).cast("string"), 2, "0"), F.lit("T00:00:00Z")))
    prompt = F.concat(F.lit("  "), _pick([p for p, _ in PHRASES], n), F.when(n % 9 == 0, "").otherwise(F.concat(F.lit("\n"), F.regexp_replace(text, "[^A-Za-z ]+", " "))))
    key, value = _pick([x[1] for x in CALLS], n), F.replace(F.replace(_pick([x[2] for x in CALLS], n), F.lit("{c}"), c.cast("string")), F.lit("{m}"), (n % 3).cast("string"))
    given = F.when(key == "", '{"z":1,"a":"x"}').otherwise(F.concat(F.lit('{"'), key, F.lit('":"'), value, F.lit('"}')))
    quoted = lambda x: F.to_json(F.struct(x.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(x.alias("x")))) - 6)  # noqa: E731  a text as a JSON string
    call_id, name = F.concat(F.lit('"c'), t.cast("string"), F.lit('"')), quoted(_pick([x[0] for x in CALLS], n))
    told = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    user, assistant, a = F.col("role") == "user", F.col("role") == "assistant", c % 2 == 0
    at = told('"timestamp":', quoted(stamp))
    ok, replied = n % 5 != 0, n % 4 != 3
    content = F.when(n % 13 == 6, told('[{"type":"text","text":', quoted(prompt), '},{"type":"image"}]')).otherwise(quoted(prompt))
    line = lambda k, cond, raw: F.when(cond, F.struct(F.lit(k).alias("k"), raw.alias("raw")))
    lines = F.array(
        line(0, ~user & ~assistant, told("{malformed ", c.cast("string"))),
        line(0, a & user, told('{"type":"user",', at, F.when(n % 11 == 5, ',"isMeta":true').otherwise(""), ',"message":{"role":"user","content":', content, "}}")),
        line(0, a & assistant, told('{"type":"assistant",', at, ',"message":{"role":"assistant","content":[{"type":"text","text":', quoted(text), '},{"type":"tool_use","id":', call_id, ',"name":', name, ',"input":', given, "}]}}")),
        line(1, a & assistant & replied, told('{"type":"user","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":', call_id, ',"is_error":', F.when(ok, "false").otherwise("true"), "}]}}")),
        line(0, ~a & user, told('{"type":"response_item",', at, ',"payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"<environment_context> x"},{"type":"input_text","text":', quoted(prompt), "}]}}")),
        line(0, ~a & assistant, told('{"type":"response_item",', at, ',"payload":{"type":"message","role":"assistant","content":[{"type":"output_text","text":', quoted(text), "}]}}")),
        line(1, ~a & assistant, told('{"type":"response_item",', at, ',"payload":{"type":"function_call","call_id":', call_id, ',"name":', name, ',"arguments":', quoted(given), "}}")),
        line(2, ~a & assistant & replied, told('{"type":"response_item","payload":{"type":"function_call_output","call_id":', call_id, ',"output":', F.when(ok, quoted(F.lit('{"exit_code": 0}'))).otherwise(quoted(F.lit('{"exit_code": 2}'))), "}}")),
        line(3, ~a & (c % 7 == 3) & (t == 4), F.lit('{"type":"session_meta","payload":{"source":{"subagent":"x"}}}')),
    )
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("SRC-"), c.cast("string")).alias("source_ref"), F.when(a, "claude_home").otherwise("codex_rollout").alias("provider"), t, F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("l"))
    return rows.select("source_ref", "provider", (F.col("turn") * 4 + F.col("l.k") + 1).cast("int").alias("line"), F.col("l.raw").alias("raw"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    cases = F.when(c % 3 == 0, F.array(F.lit("STATION-WIDE"))).otherwise(F.array(F.lit("C1"), F.lit("C2")))
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.concat(F.lit("SRC-"), c.cast("string")).alias("source_ref"), F.concat(F.lit("ST"), F.lpad((c % 13).cast("string"), 2, "0")).alias("station_id"), cases.alias("case_ids"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.records(raw_lines(spark, sf_dir), CONTRACT, CUTOFF)


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.screened(screen.episodes(_records(spark, sf_dir)), sources(spark, sf_dir), CONTRACT)


def _case(values, n: str) -> str:
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _count(patterns, flags: str = "i", over: str = "p") -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({over}, {_text(p)}, '{flags}') AS INT)" for p in patterns) + ")"


def _names(groups) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_count(ps, 'is')} > 0 THEN '{name}' END" for name, ps in groups.items()) + "], lambda x: x IS NOT NULL)"


_C = CONTRACT
_VALUES = [_text(x[2]).replace("{c}", "' || c || '").replace("{m}", "' || (n % 3) || '") if x[1] else "CASE WHEN a THEN '{\"a\":\"x\",\"z\":1}' ELSE '{\"z\":1,\"a\":\"x\"}' END" for x in CALLS]

LINES_SQL = f"""
b AS (SELECT CAST(conv_id AS BIGINT) AS c, CAST(turn AS INT) AS t, conv_id + turn AS n, conv_id % 2 = 0 AS a, role, coalesce(text, '') AS text FROM conversations),
d AS (SELECT *, CASE WHEN n % 17 = 4 THEN 'no time' ELSE '2026-01-' || lpad(CAST(1 + n % 28 AS VARCHAR), 2, '0') || 'T00:00:00Z' END AS stamp, n % 17 <> 4 AND 1 + n % 28 > 25 AS late FROM b),
ln AS (SELECT *, t * 4 + 1 AS line, CASE WHEN role IN ('user', 'assistant') THEN stamp ELSE '' END AS ts, late AND role IN ('user', 'assistant') AS excluded, role NOT IN ('user', 'assistant') AS malformed, 0 AS k FROM d
       UNION ALL SELECT *, t * 4 + 2, CASE WHEN a THEN '' ELSE stamp END, NOT a AND late, false, 1 FROM d WHERE role = 'assistant' AND (NOT a OR n % 4 <> 3)
       UNION ALL SELECT *, t * 4 + 3, '', false, false, 2 FROM d WHERE role = 'assistant' AND NOT a AND n % 4 <> 3
       UNION ALL SELECT *, t * 4 + 4, '', false, false, 3 FROM d WHERE NOT a AND c % 7 = 3 AND t = 4),
mk AS (SELECT c, min(line) AS mark FROM ln WHERE k = 3 GROUP BY c),
kp AS (SELECT ln.*, mark, role = 'user' AND k = 0 AND NOT (a AND n % 11 = 5) AS opens FROM ln LEFT JOIN mk USING (c) WHERE NOT malformed AND NOT excluded AND (mark IS NULL OR line < mark)),
sn AS (SELECT *, max(CASE WHEN opens THEN line END) OVER (PARTITION BY c ORDER BY line) AS start FROM kp),
bg AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY line) AS turn_index, line = max(line) OVER (PARTITION BY c) AS newest FROM sn WHERE opens),
op AS (SELECT c, a, n, line AS start, turn_index, ts AS timestamp_start,
         trim({_case([_text(p) for p, _ in PHRASES], 'n')} || CASE WHEN n % 9 = 0 THEN '' ELSE chr(10) || regexp_replace(text, '[^A-Za-z ]+', ' ', 'g') END, ' ' || chr(10)) AS p,
         {_case([str(r) for _, r in PHRASES], 'n')} AS refs, CASE WHEN a AND n % 13 = 6 THEN 1 ELSE 0 END AS attachment_count
       FROM bg WHERE NOT (newest AND mark IS NOT NULL)),
bd AS (SELECT c, start, max(line) AS source_line_end, arg_max(ts, line) FILTER (WHERE ts <> '') AS last_ts,
         count(*) FILTER (WHERE role = 'assistant' AND k = 0) AS blocks, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant' AND k = 0), 0) AS chars FROM sn GROUP BY 1, 2),
cl AS (SELECT x.c, x.start, x.line, {_case([_text(v[0]) for v in CALLS], 'x.n')} AS name, {_case([_text(v[3]) for v in CALLS], 'x.n')} AS class, r.line IS NOT NULL AS completed, r.line IS NOT NULL AND x.n % 5 <> 0 AS succeeded,
         'TGT-' || substr(sha256({_case(_VALUES, 'x.n').replace(' || c || ', ' || x.c || ').replace('(n % 3)', '(x.n % 3)').replace('WHEN a THEN', 'WHEN x.a THEN')}), 1, 20) AS target_ref
       FROM sn x LEFT JOIN sn r ON r.c = x.c AND r.t = x.t AND r.role = 'assistant' AND r.start = x.start AND r.k = x.k + 1 AND r.k = CASE WHEN x.a THEN 1 ELSE 2 END
       WHERE x.role = 'assistant' AND x.start IS NOT NULL AND x.k = CASE WHEN x.a THEN 0 ELSE 1 END),
oc AS (SELECT cl.*, row_number() OVER (PARTITION BY cl.c, cl.start ORDER BY cl.line) AS "order" FROM cl JOIN op USING (c, start))
"""
_DONE = "completed AND succeeded AND class"
SCREEN_SQL = (
    "WITH"
    + LINES_SQL.rstrip()
    + f""",
fs AS (SELECT c, start, min("order") FILTER (WHERE {_DONE} IN ('modify', 'execute', 'verify')) AS first FROM oc GROUP BY 1, 2),
cc AS (SELECT c, start, count(*) AS tool_calls, count(*) FILTER (WHERE completed AND succeeded) AS completed_tool_calls, count(*) FILTER (WHERE class IN ('retrieve', 'search')) AS context_retrieval_calls,
         count(*) FILTER (WHERE {_DONE} IN ('retrieve', 'search')) AS completed_context_retrieval_calls, count(*) FILTER (WHERE {_DONE} IN ('retrieve', 'search') AND "order" < coalesce(first, 1000000000)) AS before,
         count(DISTINCT target_ref) FILTER (WHERE {_DONE} IN ('retrieve', 'search') AND "order" < coalesce(first, 1000000000)) AS targets, count(*) FILTER (WHERE class IN ('modify', 'execute', 'verify')) AS substantive,
         count(*) FILTER (WHERE {_DONE} IN ('modify', 'execute', 'verify')) AS acted, count(*) FILTER (WHERE class = 'modify') AS mutation_calls, count(*) FILTER (WHERE class = 'execute') AS execution_calls,
         count(*) FILTER (WHERE class = 'verify') AS verification_calls, count(*) FILTER (WHERE class = 'delegate') AS delegate_calls FROM oc JOIN fs USING (c, start) GROUP BY 1, 2),
tx AS (SELECT op.*, {_names(_C['stages'])} AS stages, {' + '.join(_count(ps, 'is') for ps in _C['stages'].values())} AS stage_count, {_names(_C['context_modes'])} AS named, {' + '.join(_count(ps, 'is') for ps in _C['context_modes'].values())} AS hits,
         {_count(_C['publication_exclusions'])} > 0 AS publication, {_count(_C['non_product_exclusions'])} > 0 AS non_product, {_count([f'^(?:{x})$' for x in _C['continuation_only']])} > 0 AS continuation, {_count(_C['product_signals'])} AS products,
         CASE WHEN {_count(_C['continuation_wrappers'])} > 0 THEN 'continuation_wrapper' WHEN {_count(_C['tool_generated_prompts'])} > 0 THEN 'tool_generated' WHEN {_count(_C['delegated_prompt_candidates'])} > 0 THEN 'delegated_agent_prompt_candidate'
           WHEN starts_with(lower(p), 'automation:') THEN 'scheduled_automation' ELSE 'direct_or_unresolved_user_level' END AS origin FROM op),
ty AS (SELECT tx.*, list_concat(list_concat(named, CASE WHEN refs >= 2 AND NOT list_contains(named, 'bounded_package') THEN ['bounded_package'] ELSE [] END), CASE WHEN refs >= 3 AND NOT list_contains(named, 'multi_source_synthesis') THEN ['multi_source_synthesis'] ELSE [] END) AS modes,
         hits + CAST(refs >= 2 AS INT) + CAST(refs >= 3 AND NOT list_contains(named, 'multi_source_synthesis') AS INT) AS explicit, bd.* EXCLUDE (c, start), cc.* EXCLUDE (c, start) FROM tx JOIN bd USING (c, start) LEFT JOIN cc USING (c, start)),
tz AS (SELECT *, coalesce(acted, 0) > 0 AS has_acted, (list_has_any(stages, ['requirements', 'design', 'audit', 'verification']) AND coalesce(completed_context_retrieval_calls, 0) > 0 AND chars >= {_C['minimum_assistant_output_chars_for_decision']}) AS decision,
         coalesce(targets, 0) >= {_C['minimum_distinct_retrieval_targets_for_implicit_context']} AS implicit FROM ty),
ta AS (SELECT *, has_acted OR decision AS action, products + stage_count > 0 OR has_acted AS purpose, explicit > 0 OR implicit OR attachment_count > 0 AS context,
         (explicit > 0 AND (coalesce(before, 0) > 0 OR attachment_count > 0 OR (list_contains(modes, 'history_memory') AND NOT continuation))) OR (implicit AND (has_acted OR decision)) AS observed FROM tz),
sc AS (SELECT 'CEI-' || substr(sha256('SRC-' || c || '|' || turn_index || '|' || sha256(p)), 1, 20) AS episode_id, 'ST' || lpad(CAST(c % 13 AS VARCHAR), 2, '0') AS station_id, CASE WHEN a THEN 'claude_home' ELSE 'codex_rollout' END AS provider,
  'SRC-' || c AS source_ref, 'SS-' || c AS session_ref, turn_index, start AS source_line_start, source_line_end, timestamp_start, coalesce(last_ts, timestamp_start) AS timestamp_end,
  CASE WHEN timestamp_start <> '' THEN 'observed' ELSE 'missing' END AS timestamp_status, 'PR-' || substr(sha256(p), 1, 20) AS prompt_ref, length(p) AS prompt_chars, len(list_filter(regexp_split_to_array(p, '\\s+'), lambda x: x <> '')) AS prompt_words,
  attachment_count, coalesce(tool_calls, 0) AS tool_calls, coalesce(completed_tool_calls, 0) AS completed_tool_calls, coalesce(context_retrieval_calls, 0) AS context_retrieval_calls, coalesce(completed_context_retrieval_calls, 0) AS completed_context_retrieval_calls,
  coalesce(before, 0) AS context_retrieval_calls_before_action, coalesce(targets, 0) AS distinct_context_targets_before_action, coalesce(substantive, 0) AS substantive_action_calls, coalesce(acted, 0) AS completed_substantive_action_calls,
  coalesce(mutation_calls, 0) AS mutation_calls, coalesce(execution_calls, 0) AS execution_calls, coalesce(verification_calls, 0) AS verification_calls, coalesce(delegate_calls, 0) AS delegate_calls, blocks AS assistant_output_blocks, CAST(chars AS BIGINT) AS assistant_output_chars,
  coalesce(array_to_string(stages, '|'), '') AS stage_signal_mask, stage_count AS stage_signal_count, coalesce(array_to_string(modes, '|'), '') AS context_mode_mask, explicit AS explicit_context_signal_count, refs AS prompt_artifact_reference_count,
  products + stage_count AS product_signal_count, CASE WHEN publication THEN 'yes' ELSE 'no' END AS publication_exclusion_candidate, CASE WHEN continuation THEN 'yes' ELSE 'no' END AS continuation_only_candidate, origin AS origin_candidate,
  count(*) OVER (PARTITION BY p) AS prompt_reuse_count, CASE WHEN decision THEN 'yes' ELSE 'no' END AS grounded_decision_trace,
  CASE WHEN observed AND action THEN 'context_supplied_then_product_action_observed' WHEN context AND action THEN 'context_signal_and_action_without_ordered_use_trace' WHEN context THEN 'context_signal_without_product_action'
    WHEN action THEN 'product_action_without_context_operation' ELSE 'neither_context_nor_product_action_observed' END AS context_trace_status, CASE WHEN action THEN 'observed' ELSE 'not_observed' END AS product_action_trace_status,
  CASE WHEN origin = 'continuation_wrapper' THEN 'exclude_continuation_wrapper' WHEN origin = 'tool_generated' THEN 'exclude_tool_generated_prompt' WHEN origin = 'delegated_agent_prompt_candidate' THEN 'exclude_delegated_prompt_candidate'
    WHEN publication THEN 'exclude_publication_candidate' WHEN non_product THEN 'exclude_non_product_candidate' WHEN continuation THEN 'exclude_continuation_only' WHEN NOT purpose THEN 'exclude_non_product_candidate'
    WHEN NOT action THEN 'exclude_no_observable_product_action' WHEN NOT context THEN 'exclude_no_context_operation' WHEN observed THEN 'candidate_strong' ELSE 'candidate_probable' END AS automated_disposition,
  CASE WHEN c % 3 = 0 THEN 'STATION-WIDE' ELSE 'C1|C2' END AS candidate_case_ids, CASE WHEN c % 3 = 0 THEN 'station_wide_unanchored' ELSE 'automated_source_membership_candidate' END AS case_scope_status,
  '{_C['rule_version']}' AS rule_version, '{_C['cutoff_id']}' AS cutoff_id, 'unreviewed' AS review_status FROM ta)
"""
)
HEADER = (
    "episode_id", "station_id", "provider", "source_ref", "session_ref", "turn_index", "source_line_start", "source_line_end", "timestamp_start", "timestamp_end", "timestamp_status",
    "prompt_ref", "prompt_chars", "prompt_words", "attachment_count", "tool_calls", "completed_tool_calls", "context_retrieval_calls", "completed_context_retrieval_calls",
    "context_retrieval_calls_before_action", "distinct_context_targets_before_action", "substantive_action_calls", "completed_substantive_action_calls", "mutation_calls", "execution_calls",
    "verification_calls", "delegate_calls", "assistant_output_blocks", "assistant_output_chars", "stage_signal_mask", "stage_signal_count", "context_mode_mask", "explicit_context_signal_count",
    "prompt_artifact_reference_count", "product_signal_count", "publication_exclusion_candidate", "continuation_only_candidate", "origin_candidate", "prompt_reuse_count", "grounded_decision_trace",
    "context_trace_status", "product_action_trace_status", "automated_disposition", "candidate_case_ids", "case_scope_status", "rule_version", "cutoff_id", "review_status",
)


@query("transcript_lines", "WITH" + LINES_SQL + """SELECT 'SRC-' || c AS source_ref, line, malformed, ts, excluded, ts = 'no time' AS invalid_time, k = 3 AS subagent,
CASE WHEN role = 'assistant' AND k = 0 THEN length(text) ELSE 0 END AS chars, CASE WHEN role = 'assistant' AND k = CASE WHEN a THEN 0 ELSE 1 END THEN 1 ELSE 0 END AS n_calls, CASE WHEN role = 'assistant' AND k = CASE WHEN a THEN 1 ELSE 2 END THEN 1 ELSE 0 END AS n_results FROM ln""")
def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return _records(spark, sf_dir).select("source_ref", "line", "malformed", "ts", "excluded", "invalid_time", "subagent", "chars", F.greatest(size("calls"), F.lit(0)).alias("n_calls"), F.greatest(size("results"), F.lit(0)).alias("n_results"))


@query("transcript_calls", "WITH" + LINES_SQL + "SELECT 'SRC-' || c AS source_ref, start AS source_line_start, \"order\", name, class, completed, succeeded, target_ref FROM oc")
def transcript_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = screen.episodes(_records(spark, sf_dir)).select("source_ref", "source_line_start", F.explode("calls").alias("x"))
    return rows.select("source_ref", "source_line_start", "x.order", "x.name", "x.class", "x.completed", "x.succeeded", "x.target_ref")


@query("transcript_quality", "WITH" + LINES_SQL + """, q AS (SELECT c, count(*) FILTER (WHERE malformed) AS m, count(*) FILTER (WHERE NOT malformed AND excluded) AS e, count(*) FILTER (WHERE NOT malformed AND ts = 'no time') AS i, bool_or(k = 3) AS s FROM ln GROUP BY c)
SELECT 'ST' || lpad(CAST(c % 13 AS VARCHAR), 2, '0') AS station_id, count(*) AS sources_scanned, CAST(sum(m) AS BIGINT) AS malformed_rows, CAST(sum(e) AS BIGINT) AS timestamp_excluded_rows, CAST(sum(i) AS BIGINT) AS invalid_timestamp_rows, count(*) FILTER (WHERE s) AS subagent_sources_excluded FROM q GROUP BY 1""")
def transcript_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.source_quality(_records(spark, sf_dir), sources(spark, sf_dir))


@query("screen_episodes", SCREEN_SQL + "SELECT " + ", ".join(HEADER) + " FROM sc")
def screen_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screened(spark, sf_dir).select(*HEADER)


@query("screen_review_queue", SCREEN_SQL + """SELECT 'CER-' || substr(sha256(episode_id), 1, 20) AS context_review_id, episode_id, station_id, provider, source_ref, session_ref, prompt_ref, timestamp_start, candidate_case_ids, case_scope_status,
automated_disposition, context_mode_mask, stage_signal_mask, context_trace_status, product_action_trace_status, origin_candidate, prompt_reuse_count, CASE automated_disposition WHEN 'candidate_strong' THEN 'high' ELSE 'moderate' END AS review_priority, 'pending' AS review_status,
row_number() OVER (ORDER BY CASE automated_disposition WHEN 'candidate_strong' THEN 0 ELSE 1 END, station_id, episode_id) AS place FROM sc WHERE automated_disposition IN ('candidate_strong', 'candidate_probable')""")
def screen_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place: where the row stands in the queue, counted over ranges of it."""
    columns = ["context_review_id", "episode_id", "station_id", "provider", "source_ref", "session_ref", "prompt_ref", "timestamp_start", "candidate_case_ids", "case_scope_status", "automated_disposition", "context_mode_mask", "stage_signal_mask", "context_trace_status", "product_action_trace_status", "origin_candidate", "prompt_reuse_count", "review_priority", "review_status"]
    return screen.queue_places(screen.review_queue(_screened(spark, sf_dir))).select(*columns, "place")


@query("screen_rollup", SCREEN_SQL + "SELECT station_id, coalesce(provider, 'ALL') AS provider, automated_disposition, count(*) AS episodes FROM sc GROUP BY GROUPING SETS ((station_id, provider, automated_disposition), (station_id, automated_disposition))")
def screen_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.disposition_rollup(_screened(spark, sf_dir))


@query("screen_receipts", SCREEN_SQL + """SELECT station_id, count(*) AS episodes, count(DISTINCT source_ref) AS sources, count(DISTINCT prompt_ref) AS distinct_prompts, count(*) FILTER (WHERE automated_disposition = 'candidate_strong') AS strong,
count(*) FILTER (WHERE automated_disposition = 'candidate_probable') AS probable, count(*) FILTER (WHERE prompt_reuse_count > 1) AS reused FROM sc GROUP BY 1""")
def screen_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.run_receipts(_screened(spark, sf_dir))
