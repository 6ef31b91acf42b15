"""Declarative rules over prompts and tool calls, as native columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import yes

# Parts of tool names by class, in order of precedence, and commands by regular expression.
ADMINISTRATIVE = ("taskupdate", "taskcreate", "update_plan", "request_user_input", "askuser", "wait", "list_agents", "send_message", "present_files", "toolsearch")
DELEGATE = ("agent", "spawn", "delegate", "followup_task")
MODIFY = ("edit", "write", "create", "apply_patch", "notebookedit", "imagegen")
VERIFY = ("test", "validate", "lint", "verify")
SEARCH = ("grep", "glob", "search", "find")
RETRIEVE = ("read", "open", "fetch", "view_image", "screenshot")
SHELL = ("bash", "terminal", "exec", "shell", "javascript", "js")
EXECUTE = ("click", "navigate", "type", "browser", "deploy", "publish")
MUTATION_COMMAND = r"\b(?:apply_patch|mkdir|touch|chmod|cp|mv|rm|git\s+(?:add|commit|push)|npm\s+install|pip\s+install)\b|(?:^|\s)(?:>>?|tee)\s"
VERIFY_COMMAND = r"\b(?:pytest|npm\s+(?:test|run\s+(?:test|build|lint))|pnpm\s+(?:test|run)|yarn\s+(?:test|run)|go\s+test|cargo\s+test|tsc|validate|replay|check)\b"
READ_ONLY_COMMAND = r"^(?:cd\s+\S+\s*(?:&&|;|$)\s*)?(?:rg|grep|sed\s+-n|head|tail|ls|find|git\s+(?:status|diff|log|show|rev-parse|branch)|wc|stat|du|file|jq|pwd|which|type|mdls)\b"
SEARCH_COMMAND = r"\b(?:rg|grep|find)\b"
ARTIFACT = r"(?<!\w)(?:[./~][^\s,;:()<>\[\]{}]+|[A-Za-z0-9_.-]+\.(?:md|txt|json|ya?ml|csv|tsv|py|mjs|js|ts|tsx|jsx|html|css|docx|pdf|pptx|xlsx|zip))(?!\w)"
SCHEDULED_TAG, SCHEDULED_WORD, SCHEDULED_PHRASE = "<scheduled-task", "automation:", "this is an automated run of a scheduled task"
DECISION_STAGES = ("requirements", "design", "audit", "verification")
SUBSTANTIVE, CONTEXT = ("modify", "execute", "verify"), ("retrieve", "search")

#: Flags of Python's str patterns: Unicode classes and folding; the dot takes line ends only where asked.
_ANY, _DOTALL = "(?iU)", "(?isU)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def hits(text: Column, patterns: Sequence[str], flags: str = _ANY) -> Column:
    """How many of the patterns are found."""
    return reduce(lambda a, b: a + b, [text.rlike(flags + p).cast("int") for p in patterns], F.lit(0))


def groups_hit(text: Column, groups: Mapping[str, Sequence[str]]) -> tuple[Column, Column]:
    """Names of the groups with a hit, in the contract's order, and the number of all patterns that hit."""
    counts = {name: hits(text, patterns, _DOTALL) for name, patterns in groups.items()}
    names = F.filter(F.array(*[F.when(n > 0, F.lit(name)) for name, n in counts.items()]), lambda x: x.isNotNull())
    return names, reduce(lambda a, b: a + b, counts.values(), F.lit(0))


def artifact_references(text: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(_ANY + ARTIFACT), F.lit(0))))


def tool_class(name: Column, text: Column, target: Column) -> Column:
    """Class of a call from its name, and for a shell from its input text and target."""
    key = F.lower(name)
    has = lambda parts: reduce(lambda a, b: a | b, [key.contains(p) for p in parts])
    command = strip(target)
    shell = (
        F.when(text.rlike(_ANY + MUTATION_COMMAND) | text.contains("apply_patch"), "modify")
        .when(text.rlike(_ANY + VERIFY_COMMAND), "verify")
        .when(command.rlike(_ANY + READ_ONLY_COMMAND), F.when(command.rlike(_ANY + SEARCH_COMMAND), "search").otherwise("retrieve"))
        .otherwise("execute")
    )
    return (
        F.when(has(ADMINISTRATIVE), "administrative").when(has(DELEGATE), "delegate").when(has(MODIFY), "modify").when(has(VERIFY), "verify")
        .when(has(SEARCH), "search").when(has(RETRIEVE), "retrieve").when(has(SHELL), shell).when(has(EXECUTE), "execute").otherwise("other")
    )


def origin(prompt: Column, rules: Mapping) -> Column:
    """Who a prompt comes from: the first of wrapper, tool, delegation and schedule that fits, else the user."""
    body, left = strip(prompt), F.regexp_replace(prompt, r"(?U)^\s+", "")
    scheduled = left.startswith(SCHEDULED_TAG) | F.lower(left).startswith(SCHEDULED_WORD) | F.lower(prompt).contains(SCHEDULED_PHRASE)
    return (
        F.when(hits(body, rules["continuation_wrappers"]) > 0, "continuation_wrapper")
        .when(hits(body, rules["tool_generated_prompts"]) > 0, "tool_generated")
        .when(hits(body, rules["delegated_prompt_candidates"]) > 0, "delegated_agent_prompt_candidate")
        .when(scheduled, "scheduled_automation")
        .otherwise("direct_or_unresolved_user_level")
    )


def continuation_only(prompt: Column, patterns: Sequence[str]) -> Column:
    """Whether the whole stripped prompt is boilerplate."""
    return hits(strip(prompt), [rf"\A(?:{p})\z" for p in patterns]) > 0


# The outcome of each rule of the disposition cascade, in order, and its reason.
DISPOSITIONS = (
    ("wrapper", "exclude_continuation_wrapper", "assistant-generated context restoration or compaction summary is not a fresh user-level interaction"),
    ("tool", "exclude_tool_generated_prompt", "tool-generated delivery or result text is not a user-authored task invocation"),
    ("delegated", "exclude_delegated_prompt_candidate", "delegated-agent task prompts are evidence within a parent run, not independent user-level interactions"),
    ("publication", "exclude_publication_candidate", "publication-purpose language is categorically outside the product-event boundary"),
    ("non_product", "exclude_non_product_candidate", "business-development, sales, or marketing task language is outside the product-event boundary"),
    ("continuation", "exclude_continuation_only", "boilerplate continuation supplied no fresh context operation"),
    ("no_purpose", "exclude_non_product_candidate", "no product-purpose signal or completed substantive product action"),
    ("no_action", "exclude_no_observable_product_action", "context or task language was present but no completed product action or grounded decision was observed"),
    ("no_context", "exclude_no_context_operation", "product work was observed but no deliberate or multi-source context operation was evidenced"),
    ("observed", "candidate_strong", "context operation and ordered downstream product-use trace were both observed"),
    ("rest", "candidate_probable", "context operation and product action co-occurred but ordered use was not directly observed"),
)


def classify(ep, rules: Mapping):
    """Adds the taxonomy, gates, trace status and disposition to episodes (prompt_text, attachment_count, assistant_output_chars, calls)."""
    prompt = F.col("prompt_text")
    stages, stage_count = groups_hit(prompt, rules["stages"])
    modes, mode_count = groups_hit(prompt, rules["context_modes"])
    ep = ep.withColumns({"_stages": stages, "stage_signal_count": stage_count, "_modes": modes, "_hits": mode_count, "prompt_artifact_reference_count": artifact_references(prompt)})
    refs, calls = F.col("prompt_artifact_reference_count"), F.col("calls")
    package = (refs >= 2) & ~F.array_contains("_modes", "bounded_package")
    synthesis = (refs >= 3) & ~F.array_contains("_modes", "multi_source_synthesis")
    none = F.array().cast("array<string>")
    modes = F.concat("_modes", F.when(package, F.array(F.lit("bounded_package"))).otherwise(none), F.when(synthesis, F.array(F.lit("multi_source_synthesis"))).otherwise(none))
    of = lambda array, classes: F.filter(array, lambda x: x["class"].isin(*classes))
    done = F.filter(calls, lambda x: x["completed"] & x["succeeded"])
    ep = ep.withColumns(
        {
            "_modes": modes,
            "explicit_context_signal_count": F.col("_hits") + (refs >= 2).cast("int") + synthesis.cast("int"),
            "_done": done,
            "publication_exclusion_candidate": yes(hits(prompt, rules["publication_exclusions"]) > 0),
            "_non_product": hits(prompt, rules["non_product_exclusions"]) > 0,
            "_continuation": continuation_only(prompt, rules["continuation_only"]),
            "origin_candidate": origin(prompt, rules),
            "product_signal_count": hits(prompt, rules["product_signals"]) + F.col("stage_signal_count"),
        }
    )
    acts, looks = of(F.col("_done"), SUBSTANTIVE), of(F.col("_done"), CONTEXT)
    first = F.coalesce(F.array_min(F.transform(acts, lambda x: x["order"])), F.lit(10**9))
    ep = ep.withColumns({"completed_substantive_action_calls": F.size(acts), "completed_context_retrieval_calls": F.size(looks), "_before": F.filter(looks, lambda x: x["order"] < first)})
    targets = F.array_distinct(F.filter(F.transform("_before", lambda x: x["target_ref"]), lambda x: x != ""))
    decision = F.arrays_overlap("_stages", F.array(*[F.lit(s) for s in DECISION_STAGES])) & (F.col("completed_context_retrieval_calls") > 0) & (F.col("assistant_output_chars") >= int(rules["minimum_assistant_output_chars_for_decision"]))
    ep = ep.withColumns({"context_retrieval_calls_before_action": F.size("_before"), "distinct_context_targets_before_action": F.size(targets), "_decision": decision})
    acted = F.col("completed_substantive_action_calls") > 0
    action, purpose = acted | F.col("_decision"), (F.col("product_signal_count") > 0) | acted
    implicit = F.col("distinct_context_targets_before_action") >= int(rules["minimum_distinct_retrieval_targets_for_implicit_context"])
    explicit, attached = F.col("explicit_context_signal_count") > 0, F.col("attachment_count") > 0
    context = explicit | implicit | attached
    history = F.array_contains("_modes", "history_memory") & ~F.col("_continuation")
    observed = (explicit & ((F.col("context_retrieval_calls_before_action") > 0) | attached | history)) | (implicit & action)
    status = (
        F.when(observed & action, "context_supplied_then_product_action_observed")
        .when(context & action, "context_signal_and_action_without_ordered_use_trace")
        .when(context, "context_signal_without_product_action")
        .when(action, "product_action_without_context_operation")
        .otherwise("neither_context_nor_product_action_observed")
    )
    from_ = F.col("origin_candidate")
    tests = {
        "wrapper": from_ == "continuation_wrapper", "tool": from_ == "tool_generated", "delegated": from_ == "delegated_agent_prompt_candidate",
        "publication": F.col("publication_exclusion_candidate") == "yes", "non_product": F.col("_non_product"), "continuation": F.col("_continuation"),
        "no_purpose": ~purpose, "no_action": ~action, "no_context": ~context, "observed": observed, "rest": F.lit(True),
    }
    label = reason = None
    for test, name, why in DISPOSITIONS:
        label = F.when(tests[test], name) if label is None else label.when(tests[test], name)
        reason = F.when(tests[test], why) if reason is None else reason.when(tests[test], why)
    count = lambda *classes: F.size(of(calls, classes))
    out = ep.withColumns(
        {
            "stage_signal_mask": F.array_join("_stages", "|"), "context_mode_mask": F.array_join("_modes", "|"), "continuation_only_candidate": yes(F.col("_continuation")),
            "tool_calls": F.size(calls), "completed_tool_calls": F.size("_done"), "context_retrieval_calls": count(*CONTEXT), "substantive_action_calls": count(*SUBSTANTIVE),
            "mutation_calls": count("modify"), "execution_calls": count("execute"), "verification_calls": count("verify"), "delegate_calls": count("delegate"),
            "grounded_decision_trace": yes(F.col("_decision")), "context_trace_status": status, "product_action_trace_status": F.when(action, "observed").otherwise("not_observed"),
            "automated_disposition": label, "disposition_basis": reason,
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])
