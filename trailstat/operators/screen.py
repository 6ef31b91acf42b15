"""Raw transcripts to classified episodes: a prompt and everything up to the next one of its source."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json
from ..functions.scalars import EPISODE_SALT, canonical_mask, duration_minutes, frontloaded, is_yes, mask, month, per_action, session_of, token, verification_successful, words, yes
from .ranking import hash_rank, latest_before, running_count
from .rules import classify, strip, tool_class

# Fixed values of the two transcript formats.
MESSAGE_PROVIDERS = ("claude_audit", "claude_home", "claude_embedded")
PAYLOAD_PROVIDER = "codex_rollout"
TARGET_KEYS = ("file_path", "path", "directory", "cwd", "notebook_path", "ref_id", "url", "query", "pattern", "cmd", "command")
FAILED = r'(?i)"(?:exit_code|isError)"\s*:\s*(?:[1-9][0-9]*|true)'
TARGET_CHARS = 4000
#: Lines of a source that one window sees.
STRETCH = 100_000


def _get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _items(content: Column) -> Column:
    return F.when(_is(content, "ARRAY"), F.try_variant_get(content, "$", "array<variant>"))


def content_texts(content: Column, accepted: tuple[str, ...]) -> Column:
    """A text as one block; of a list, the texts of items of an accepted type."""
    none = F.array().cast("array<string>")
    listed = F.filter(_items(content), lambda i: _get(i, "$.type").isin(*accepted) & _is(_get(i, "$.text", "variant"), "STRING"))
    return F.when(_is(content, "STRING"), F.array(F.try_variant_get(content, "$", "string"))).otherwise(F.coalesce(F.transform(listed, lambda i: _get(i, "$.text")), none))


def _truth(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "boolean"), F.lit(False))


def timestamp_text(v: Column) -> Column:
    given = [F.nullif(_get(v, p), F.lit("")) for p in ("$._audit_timestamp", "$.timestamp", "$.payload.timestamp")]
    return F.coalesce(*given, F.lit(""))


def records(lines: DataFrame, rules: Mapping, cutoff: str) -> DataFrame:
    """Lines (source_ref, provider, line, raw) as typed records; both formats in the same columns.

    malformed: no JSON object or value. excluded: a time after the cutoff. invalid_time: a time that
    can't be read (the record stays).
    """
    v = F.col("v")
    rows = lines.withColumn("v", F.try_parse_json("raw")).withColumn("malformed", F.col("v").isNull())
    a, b = F.col("provider").isin(*MESSAGE_PROVIDERS), F.col("provider") == PAYLOAD_PROVIDER
    ts = timestamp_text(v)
    rows = rows.withColumns({"ts": ts, "type": _get(v, "$.type"), "kind": _get(v, "$.payload.type"), "message": _get(v, "$.message.content", "variant"), "payload": _get(v, "$.payload.content", "variant")})
    rows = rows.withColumn("parsed", F.try_to_timestamp(F.regexp_replace("ts", "Z", "+00:00")))
    rows = rows.withColumns({"excluded": F.coalesce(F.col("parsed") > F.lit(cutoff).cast("timestamp"), F.lit(False)), "invalid_time": (F.col("ts") != "") & F.col("parsed").isNull()})
    item = F.col("type") == "response_item"
    meta = b & (F.col("type") == "session_meta") & F.array_contains(F.coalesce(F.json_object_keys(F.to_json(_get(v, "$.payload.source", "variant"))), F.array().cast("array<string>")), "subagent")

    items = _items(F.col("message"))
    no_result = ~F.coalesce(F.exists(items, lambda i: _get(i, "$.type") == "tool_result"), F.lit(False))
    user_a = a & (F.col("type") == "user") & ~_truth(v, "$.isMeta") & ~_truth(v, "$.isCompactSummary") & ~_truth(v, "$.isSidechain") & (_get(v, "$.message.role") == "user") & no_result
    text_a = strip(F.array_join(content_texts(F.col("message"), ("text", "input_text", "output_text")), "\n"))
    user_b = b & item & (F.col("kind") == "message") & (_get(v, "$.payload.role") == "user")
    prefixes = F.array(*[F.lit(p.lower()) for p in rules["nonhuman_block_prefixes"]])
    blocks = F.transform(content_texts(F.col("payload"), ("input_text", "text")), strip)
    text_b = strip(F.array_join(F.filter(blocks, lambda x: ~F.exists(prefixes, lambda p: F.lower(x).startswith(p))), "\n"))
    attachments = F.when(user_a, F.coalesce(F.size(F.filter(items, lambda i: _get(i, "$.type").isin("image", "document"))), F.lit(0))).otherwise(F.lit(0))

    results_a = F.transform(F.filter(items, lambda i: (_get(i, "$.type") == "tool_result") & (F.coalesce(_get(i, "$.tool_use_id"), F.lit("")) != "")), lambda i: F.struct(_get(i, "$.tool_use_id").alias("call_id"), (~_truth(i, "$.is_error")).alias("ok")))
    call_id = F.coalesce(F.nullif(_get(v, "$.payload.call_id"), F.lit("")), _get(v, "$.payload.id"), F.lit(""))
    output = F.coalesce(_get(v, "$.payload.output"), F.lit(""))
    results_b = F.when(call_id != "", F.array(F.struct(call_id.alias("call_id"), (~output.rlike(FAILED)).alias("ok"))))
    results = F.when(a & (F.col("type") == "user"), results_a).when(b & item & F.col("kind").isin("function_call_output", "custom_tool_call_output"), results_b)

    unknown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    call = lambda i, ident, name, given: F.struct(ident.alias("call_id"), unknown(name).alias("name"), given.alias("input"))
    calls_a = F.transform(F.filter(items, lambda i: _get(i, "$.type") == "tool_use"), lambda i: call(i, F.coalesce(_get(i, "$.id"), F.lit("")), _get(i, "$.name"), F.coalesce(_get(i, "$.input", "variant"), F.parse_json(F.lit("{}")))))
    filled = lambda path: F.when(F.coalesce(_get(v, path), F.lit("")) != "", _get(v, path, "variant"))
    calls_b = F.array(call(v, call_id, _get(v, "$.payload.name"), F.coalesce(filled("$.payload.arguments"), filled("$.payload.input"), F.parse_json(F.lit("{}")))))
    calls = F.when(a & (F.col("type") == "assistant"), calls_a).when(b & item & F.col("kind").isin("function_call", "custom_tool_call"), calls_b)
    said = F.when(a & (F.col("type") == "assistant"), content_texts(F.col("message"), ("text",))).when(b & item & (F.col("kind") == "message") & (_get(v, "$.payload.role") == "assistant"), content_texts(F.col("payload"), ("output_text", "text")))
    chars = F.aggregate(F.coalesce(said, F.array().cast("array<string>")), F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    return rows.select(
        "source_ref", "provider", "line", "malformed", "ts", "excluded", "invalid_time",
        F.coalesce(meta, F.lit(False)).alias("subagent"),
        F.nullif(F.when(user_a, text_a).when(user_b, text_b), F.lit("")).alias("prompt_text"),
        attachments.alias("attachment_count"), results.alias("results"), calls.alias("calls"),
        F.coalesce(F.size(said), F.lit(0)).alias("blocks"), chars.alias("chars"),
    )


def _targets(calls: DataFrame) -> DataFrame:
    """Adds input_text (a text as it is, other input as canonical JSON) and target to calls with a variant ``input``."""
    given = F.col("input")
    is_text = _is(given, "STRING")
    rows = calls.withColumn("_text", F.when(is_text, F.try_variant_get(given, "$", "string"))).withColumn("input_text", F.coalesce("_text", canonical_json(F.to_json(given))))
    parsed = F.when(is_text, F.try_parse_json("_text")).otherwise(given)
    rows = rows.withColumn("_parsed", parsed)
    keys = [F.when(_is(_get(F.col("_parsed"), f"$.{k}", "variant"), "STRING"), F.nullif(strip(_get(F.col("_parsed"), f"$.{k}")), F.lit(""))) for k in TARGET_KEYS]
    named = F.when(_is(F.col("_parsed"), "OBJECT"), F.coalesce(*keys))
    return rows.withColumn("target", F.substring(F.coalesce(named, "input_text"), 1, TARGET_CHARS)).drop("_text", "_parsed")


def episodes(recs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Episodes (source_ref, provider, turn_index, lines, times, prompt_text, attachments, output, calls).

    From the first sub-agent mark of a source on, its records are dropped, and so is the episode then
    open. A call is completed by the last result with its id in its episode that comes after it; results
    of a line count before its calls.
    """
    marked = recs.filter("NOT malformed")
    marks = marked.filter("subagent").groupBy("source_ref").agg(F.min("line").alias("mark"))
    kept = marked.join(marks, "source_ref", "left").filter("NOT excluded AND (mark IS NULL OR line < mark)")
    order = ["line"]
    seen = latest_before(kept, ["source_ref"], order, F.col("prompt_text").isNotNull(), [], "opened", stretch)
    seen = seen.withColumn("start", F.when(F.col("prompt_text").isNotNull(), F.col("line")).otherwise(F.col("opened.line"))).filter("start IS NOT NULL")
    begun = running_count(seen.filter("line = start").select("source_ref", "provider", "start", "mark", "prompt_text", "attachment_count", F.col("ts").alias("timestamp_start")), ["source_ref"], "start", "turn_index", stretch)
    last = begun.filter("mark IS NOT NULL").groupBy("source_ref").agg(F.max("start").alias("start"))
    begun = begun.join(last, ["source_ref", "start"], "left_anti")

    body = seen.groupBy("source_ref", "start").agg(
        F.max("line").alias("source_line_end"),
        F.max(F.when(F.col("ts") != "", F.struct("line", "ts"))).alias("_end"),
        F.sum("blocks").alias("assistant_output_blocks"),
        F.sum("chars").alias("assistant_output_chars"),
    )
    calls = _targets(seen.select("source_ref", "start", "line", F.posexplode("calls").alias("i", "c")).select("source_ref", "start", "line", "i", "c.*"))
    calls = calls.withColumn("class", tool_class(F.col("name"), F.col("input_text"), F.col("target")))
    calls = calls.withColumn("target_ref", F.when(F.col("target") != "", token("TGT", F.col("target"))).otherwise("")).drop("input", "input_text", "target")
    results = seen.select("source_ref", "start", "line", F.posexplode("results").alias("i", "r")).select("source_ref", "start", "line", "i", "r.*")
    at = lambda kind: F.struct("line", F.lit(kind).alias("kind"), "i").alias("at")
    both = calls.filter("call_id <> ''").select("source_ref", "start", "call_id", at(1), F.lit(None).cast("boolean").alias("ok")).unionByName(results.select("source_ref", "start", "call_id", at(0), "ok"))
    earlier = Window.partitionBy("source_ref", "start", "call_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("call_at", F.last(F.when(F.col("ok").isNull(), F.col("at")), ignorenulls=True).over(earlier))
    done = both.filter("ok IS NOT NULL AND call_at IS NOT NULL").groupBy("source_ref", "start", "call_at").agg(F.max_by("ok", "at").alias("succeeded"))
    done = done.select("source_ref", "start", F.col("call_at.line").alias("line"), F.col("call_at.i").alias("i"), "succeeded")
    calls = calls.join(done, ["source_ref", "start", "line", "i"], "left")
    one = F.struct("line", "i", "name", "class", F.col("succeeded").isNotNull().alias("completed"), F.coalesce("succeeded", F.lit(False)).alias("succeeded"), "target_ref")
    listed = calls.groupBy("source_ref", "start").agg(F.array_sort(F.collect_list(one)).alias("calls"))
    numbered = F.transform("calls", lambda c, i: F.struct((i + 1).alias("order"), c["name"].alias("name"), c["class"].alias("class"), c["completed"].alias("completed"), c["succeeded"].alias("succeeded"), c["target_ref"].alias("target_ref")))
    listed = listed.select("source_ref", "start", numbered.alias("calls"))

    out = begun.join(body, ["source_ref", "start"]).join(listed, ["source_ref", "start"], "left")
    empty = F.array().cast(listed.schema["calls"].dataType)
    return out.select(
        "source_ref", "provider", "turn_index", F.col("start").alias("source_line_start"), "source_line_end", "timestamp_start",
        F.coalesce("_end.ts", "timestamp_start").alias("timestamp_end"), "prompt_text", "attachment_count", "assistant_output_blocks", "assistant_output_chars",
        F.coalesce("calls", empty).alias("calls"),
    )


def screened(eps: DataFrame, sources: DataFrame, rules: Mapping) -> DataFrame:
    """Classified episodes with ids, reuse of prompts, and scope. ``sources``: source_ref, station_id, case_ids (array)."""
    rows = classify(eps, rules).join(sources, "source_ref")
    digest = F.sha2(F.col("prompt_text").cast("binary"), 256)
    rows = rows.withColumns(
        {
            "episode_id": token("CEI", F.concat_ws("|", "source_ref", F.col("turn_index").cast("string"), digest)),
            "session_ref": session_of(F.col("source_ref")),
            "timestamp_status": F.when(F.col("timestamp_start") != "", "observed").otherwise("missing"),
            "prompt_ref": F.concat(F.lit("PR-"), F.substring(digest, 1, 20)),
            "prompt_chars": F.length("prompt_text"),
            "prompt_words": words(F.col("prompt_text")),
            "candidate_case_ids": F.array_join("case_ids", "|"),
            "case_scope_status": F.when(F.col("case_ids") == F.array(F.lit("STATION-WIDE")), "station_wide_unanchored").otherwise("automated_source_membership_candidate"),
            "rule_version": F.lit(rules["rule_version"]),
            "cutoff_id": F.lit(rules["cutoff_id"]),
            "review_status": F.lit("unreviewed"),
        }
    ).drop("case_ids")
    # A boilerplate prompt may be a third of all rows: counts are pre-aggregated, and joined by a join Spark can split.
    reuse = rows.groupBy("prompt_ref").agg(F.count(F.lit(1)).alias("prompt_reuse_count"))
    return rows.join(reuse, "prompt_ref")


def review_queue(rows: DataFrame) -> DataFrame:
    """Candidates for review, strong ones first, then by station and episode."""
    found = rows.filter(F.col("automated_disposition").isin("candidate_strong", "candidate_probable"))
    found = found.withColumn("context_review_id", token("CER", F.col("episode_id"))).withColumn("review_priority", F.when(F.col("automated_disposition") == "candidate_strong", "high").otherwise("moderate")).withColumn("review_status", F.lit("pending"))
    return found.orderBy(F.when(F.col("review_priority") == "high", 0).otherwise(1), "station_id", "episode_id")


def transformed(rows: DataFrame) -> DataFrame:
    """Screened episodes as the comparison takes them: 19 columns. A time that can't be read leaves month and duration null."""
    at = lambda c: F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))
    start, end = at("timestamp_start"), at("timestamp_end")
    actions = F.col("completed_substantive_action_calls").cast("long")
    duration = duration_minutes(start, end)
    stages = mask(F.col("stage_signal_mask"))
    has = lambda stage: F.array_contains(stages, stage).cast("int")
    return rows.select(
        "episode_id",
        token("EP", F.col("episode_id"), EPISODE_SALT, 16).alias("episode_token"),
        "station_id",
        "provider",
        F.when(start.isNotNull(), month(F.col("timestamp_start"))).alias("month"),
        "origin_candidate",
        "automated_disposition",
        "publication_exclusion_candidate",
        yes(frontloaded(F.col("attachment_count"), F.col("prompt_artifact_reference_count"), mask(F.col("context_mode_mask")))).alias("frontloaded_context_candidate"),
        canonical_mask(F.col("stage_signal_mask")).alias("stage_signal_mask"),
        F.when(start.isNotNull() & end.isNotNull(), duration).alias("duration_min"),
        actions.alias("completed_substantive_actions"),
        F.when(start.isNotNull() & end.isNotNull(), per_action(duration, actions)).alias("min_per_action"),
        verification_successful(F.col("calls")).alias("verification_successful"),
        has("audit").alias("audit_signal"),
        has("remediation").alias("remediation_signal"),
        has("packaging_release").alias("packaging_release_signal"),
        (F.size(F.array_distinct(stages)) >= 2).cast("int").alias("multistage_signal"),
        is_yes(F.col("grounded_decision_trace")).alias("grounded_decision_trace"),
    )


def queue_places(queue: DataFrame) -> DataFrame:
    """Adds ``place`` from 1: rows are counted by priority and station, and numbered within these."""
    high = F.when(F.col("review_priority") == "high", 0).otherwise(1)
    rows = queue.withColumn("_high", high)
    sizes = rows.groupBy("_high", "station_id").agg(F.count(F.lit(1)).alias("_n"))
    # A row a priority and station: few enough for one task.
    before = Window.orderBy("_high", "station_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # Episode ids are a mark and a hash: ranked in buckets of their leading digits, so no station is one task.
    ranked = hash_rank(rows.withColumn("_hash", F.substring("episode_id", 5, 20)), ["_high", "station_id"], "_hash", "episode_id", "_row")
    return ranked.join(sizes, ["_high", "station_id"]).withColumn("place", F.col("_row") + F.col("_before")).drop("_high", "_hash", "_row", "_before")


def disposition_rollup(rows: DataFrame, disposition: str = "automated_disposition") -> DataFrame:
    """Counts by (station, provider, disposition), and by station over all providers."""
    by = F.explode(F.array(F.col("provider"), F.lit("ALL"))).alias("provider")
    return rows.select("station_id", by, disposition).groupBy("station_id", "provider", disposition).agg(F.count(F.lit(1)).alias("episodes"))


def source_quality(recs: DataFrame, sources: DataFrame) -> DataFrame:
    """Per station: sources scanned, malformed rows, rows after the cutoff, rows with an unreadable time, sub-agent sources."""
    per = recs.groupBy("source_ref").agg(
        F.count_if("malformed").alias("malformed_rows"),
        F.count_if(~F.col("malformed") & F.col("excluded")).alias("timestamp_excluded_rows"),
        F.count_if(~F.col("malformed") & F.col("invalid_time")).alias("invalid_timestamp_rows"),
        F.max(F.col("subagent") & ~F.col("malformed")).alias("subagent"),
    )
    return sources.select("source_ref", "station_id").join(per, "source_ref").groupBy("station_id").agg(F.count(F.lit(1)).alias("sources_scanned"), F.sum("malformed_rows").alias("malformed_rows"), F.sum("timestamp_excluded_rows").alias("timestamp_excluded_rows"), F.sum("invalid_timestamp_rows").alias("invalid_timestamp_rows"), F.count_if("subagent").alias("subagent_sources_excluded"))


def run_receipts(rows: DataFrame) -> DataFrame:
    """Per station: episodes, sources, distinct prompts, candidates, and episodes of reused prompts."""
    return rows.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_distinct("source_ref").alias("sources"),
        F.count_distinct("prompt_ref").alias("distinct_prompts"),
        F.count_if(F.col("automated_disposition") == "candidate_strong").alias("strong"),
        F.count_if(F.col("automated_disposition") == "candidate_probable").alias("probable"),
        F.count_if(F.col("prompt_reuse_count") > 1).alias("reused"),
    )
