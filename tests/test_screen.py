import json

import pytest
from pyspark.sql import functions as F

from trailstat.operators import rules as R
from trailstat.operators import screen

RULES = {
    "rule_version": "v1",
    "cutoff_id": "c1",
    "minimum_assistant_output_chars_for_decision": 10,
    "minimum_distinct_retrieval_targets_for_implicit_context": 2,
    "publication_exclusions": [r"\bjournal\b"],
    "non_product_exclusions": [r"\bsales deck\b"],
    "stages": {"audit": [r"\baudit\b", r"\breview\b"], "requirements": [r"\brequire"]},
    "context_modes": {"history_memory": [r"\bearlier\b"], "examples_templates": [r"\bfor example\b"]},
    "product_signals": [r"\bapi\b", r"\bbuild\b"],
    "continuation_only": [r"continue\.?"],
    "continuation_wrappers": [r"^this session is being continued"],
    "delegated_prompt_candidates": [r"^you are a sub"],
    "tool_generated_prompts": [r"^<tool"],
    "nonhuman_block_prefixes": ["<environment"],
}
T = "2026-01-01T00:00:00Z"


def a_user(text, ts=T, **more):
    return {"type": "user", "timestamp": ts, "message": {"role": "user", "content": text}} | more


def a_calls(*calls, text=None):
    items = [{"type": "tool_use", "id": i, "name": n, "input": x} for i, n, x in calls]
    return {"type": "assistant", "timestamp": T, "message": {"role": "assistant", "content": items + ([{"type": "text", "text": text}] if text else [])}}


def a_results(*results):
    return {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": i, "is_error": bad} for i, bad in results]}}


def b(kind, ts=T, **payload):
    return {"type": "response_item", "timestamp": ts, "payload": {"type": kind} | payload}


def b_user(*texts, ts=T):
    return b("message", ts, role="user", content=[{"type": "input_text", "text": t} for t in texts])


SOURCES = {
    "SRC-a": (
        "claude_home",
        [
            a_calls(("x", "Bash", {"command": "ls"})),  # before the first prompt
            a_user("  Build the API from ./a.md and ./b.md  "),
            "{malformed",
            a_results(("c1", False)),  # before its call
            a_calls(("c1", "Read", {"file_path": " notes.txt "}), ("c2", "Grep", {"pattern": "x"}), ("", "Edit", {"z": 1, "a": "é"})),
            a_results(("c1", False), ("c2", True), ("", False)),
            a_results(("c2", False)),  # the last result wins
            a_calls(("c3", "Bash", {"command": "pytest -q"}), text="done it"),
            a_user("late", "2026-03-01T00:00:00Z"),  # after the cutoff
            a_user("audit it, earlier work", "no time"),
            a_results(("c3", False)),  # after the next prompt
            a_user("meta", isMeta=True),
            a_user([{"type": "text", "text": "see"}, {"type": "image"}, {"type": "text", "text": "this"}], ""),
        ],
    ),
    "SRC-b": (
        "codex_rollout",
        [
            b_user("<Environment x", "  review the api "),
            b("function_call", call_id="f1", name="shell", arguments=json.dumps({"cmd": "cd x && rg foo"})),
            b("function_call_output", call_id="f1", output='{"exit_code": 0}'),
            b("custom_tool_call", id="f2", name="exec", input="touch y"),
            b("custom_tool_call_output", call_id="f2", output={"metadata": {"exit_code": 3}}),
            b("message", role="assistant", content=[{"type": "output_text", "text": "ok then, all good"}]),
            b_user("<environment only"),
            b_user("second"),
            {"type": "session_meta", "payload": {"source": {"subagent": "x"}}},
            b_user("third"),
        ],
    ),
}


@pytest.fixture(scope="module")
def recs(spark):
    rows = [(s, p, i, x if isinstance(x, str) else json.dumps(x)) for s, (p, lines) in SOURCES.items() for i, x in enumerate(lines, 1)]
    return screen.records(spark.createDataFrame(rows, "source_ref string, provider string, line int, raw string"), RULES, "2026-02-01T00:00:00+00:00").cache()


@pytest.mark.parametrize("stretch", [1, 3, 1000])
def test_episodes(recs, stretch):
    got = {(r["source_ref"], r["turn_index"]): r for r in screen.episodes(recs, stretch).collect()}
    assert set(got) == {("SRC-a", 1), ("SRC-a", 2), ("SRC-a", 3), ("SRC-b", 1)}
    one = got["SRC-a", 1]
    assert (one["prompt_text"], one["source_line_start"], one["source_line_end"]) == ("Build the API from ./a.md and ./b.md", 2, 8)
    assert (one["assistant_output_blocks"], one["assistant_output_chars"]) == (1, 7)
    calls = [(c["order"], c["name"], c["class"], c["completed"], c["succeeded"]) for c in one["calls"]]
    assert calls == [(1, "Read", "retrieve", True, True), (2, "Grep", "search", True, True), (3, "Edit", "modify", False, False), (4, "Bash", "verify", False, False)]
    two, three = got["SRC-a", 2], got["SRC-a", 3]
    assert (two["timestamp_start"], two["source_line_start"], two["source_line_end"]) == ("no time", 10, 12)
    assert (three["prompt_text"], three["attachment_count"], three["timestamp_start"]) == ("see\nthis", 1, "")
    b1 = got["SRC-b", 1]
    assert (b1["prompt_text"], b1["assistant_output_chars"]) == ("review the api", 17)
    assert [(c["class"], c["completed"], c["succeeded"]) for c in b1["calls"]] == [("search", True, True), ("modify", True, False)]


def test_targets_are_trimmed_or_canonical(spark, recs):
    import hashlib

    calls = {c["name"]: c["target_ref"] for r in screen.episodes(recs).collect() for c in r["calls"]}
    ref = lambda x: "TGT-" + hashlib.sha256(x.encode()).hexdigest()[:20]
    assert calls["Read"] == ref("notes.txt")
    assert calls["Edit"] == ref('{"a":"é","z":1}')
    assert calls["exec"] == ref("touch y")
    assert calls["shell"] == ref("cd x && rg foo")


def test_quality_counters(spark, recs):
    sources = spark.createDataFrame([("SRC-a", "ST00"), ("SRC-b", "ST01")], "source_ref string, station_id string")
    got = {r["station_id"]: r.asDict() for r in screen.source_quality(recs, sources).collect()}
    assert got["ST00"] == {"station_id": "ST00", "sources_scanned": 1, "malformed_rows": 1, "timestamp_excluded_rows": 1, "invalid_timestamp_rows": 1, "subagent_sources_excluded": 0}
    assert got["ST01"]["subagent_sources_excluded"] == 1


def test_screened(spark, recs):
    sources = spark.createDataFrame([("SRC-a", "ST00", ["STATION-WIDE"]), ("SRC-b", "ST01", ["C1", "C2"])], "source_ref string, station_id string, case_ids array<string>")
    rows = screen.screened(screen.episodes(recs), sources, RULES)
    got = {(r["source_ref"], r["turn_index"]): r for r in rows.collect()}
    one = got["SRC-a", 1]
    # Two references make a bounded package; a retrieval came first, but no act was completed.
    assert (one["context_mode_mask"], one["explicit_context_signal_count"], one["prompt_artifact_reference_count"]) == ("bounded_package", 1, 2)
    assert (one["completed_substantive_action_calls"], one["automated_disposition"]) == (0, "exclude_no_observable_product_action")
    assert one["case_scope_status"] == "station_wide_unanchored" and one["session_ref"] == "SS-a"
    b1 = got["SRC-b", 1]
    # The audit stage, a completed search and enough output make a grounded decision without context.
    assert (b1["stage_signal_mask"], b1["grounded_decision_trace"], b1["automated_disposition"]) == ("audit", "yes", "exclude_no_context_operation")
    assert {r["provider"]: r["episodes"] for r in screen.disposition_rollup(rows).groupBy("provider").agg(F.sum("episodes").alias("episodes")).collect()} == {"ALL": 4, "claude_home": 3, "codex_rollout": 1}
    assert screen.review_queue(rows).count() == 0
    assert {r["station_id"]: r["episodes"] for r in screen.run_receipts(rows).collect()} == {"ST00": 3, "ST01": 1}


@pytest.mark.parametrize(
    "name,text,target,want",
    [
        ("TaskUpdate", "", "", "administrative"), ("spawn_worker", "", "", "delegate"), ("MultiEdit", "", "", "modify"), ("run_lint", "", "", "verify"),
        ("Glob", "", "", "search"), ("WebFetch", "", "", "retrieve"), ("bash", "git commit -m x", "git commit -m x", "modify"), ("bash", "npm run build", "npm run build", "verify"),
        ("bash", "rg x", "rg x", "search"), ("bash", "ls", "ls", "retrieve"), ("bash", "make", "make", "execute"), ("browser_click", "", "", "execute"), ("foo", "", "", "other"),
    ],
)
def test_tool_class(spark, name, text, target, want):
    row = spark.range(1).select(R.tool_class(F.lit(name), F.lit(text), F.lit(target)).alias("c")).first()
    assert row["c"] == want


def test_prompt_rules(spark):
    texts = ["This session is being continued from", "<tool result>", "You are a subagent", " Automation: nightly", "hello", "continue", "continue now"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", R.origin(F.col("t"), RULES).alias("o"), R.continuation_only(F.col("t"), RULES["continuation_only"]).alias("c")).orderBy("i").collect()
    assert [r["o"] for r in rows] == ["continuation_wrapper", "tool_generated", "delegated_agent_prompt_candidate", "scheduled_automation"] + ["direct_or_unresolved_user_level"] * 3
    assert [r["c"] for r in rows] == [False] * 5 + [True, False]
