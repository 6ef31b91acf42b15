"""The eligibility contract of the screen. A contract of another version is read from its file (`readers.contract`)."""

from __future__ import annotations

# The contract's version, thresholds and patterns.
CONTRACT = {
    "rule_version": "context-engineering-eligibility/1.0.0",
    "cutoff_id": "CUT-20260812-A",
    "minimum_assistant_output_chars_for_decision": 100,
    "minimum_distinct_retrieval_targets_for_implicit_context": 2,
    "publication_exclusions": [
        r"\bmanuscript\b",
        r"\bpreprints?\b",
        r"\bpublication\b",
        r"\bjournal(?:s)?\b",
        r"\bjournal submission\b",
        r"\bsubmission (?:package|requirements|guidelines)\b",
        r"\breviewer response\b",
        r"\bresponse letter\b",
        r"\bpeer[- ]?review\b",
        r"\bconference paper\b",
        r"\bpaper (?:development|revision|submission|review|figure|manuscript)\b",
        r"\blatex\b",
        r"\bbibliograph(?:y|ic)\b",
        r"\bcitation(?:s)?\b",
        r"\bdissertation\b",
        r"\bdoctoral (?:study|proposal|research|chapter)\b",
        r"\bPhD proposal\b",
        r"\bthesis\b",
        r"\bAPA ?7\b",
    ],
    "non_product_exclusions": [
        r"\brequest for information\b",
        r"\brequest for proposals?\b",
        r"\bRFI[- ]?[0-9]",
        r"\bRFP[- ]?[0-9]",
        r"\bsales proposal\b",
        r"\bbusiness development\b",
        r"\bmarketing copy\b",
    ],
    "stages": {
        "requirements": [
            r"\brequirements?\b",
            r"\bacceptance criteria\b",
            r"\bconstraints?\b",
            r"\bspec(?:ification)?s?\b",
        ],
        "context": [
            r"\bcontext engineering\b",
            r"\bcontext package\b",
            r"\bcontext window\b",
            r"\bcontext stack\b",
        ],
        "design": [
            r"\bdesign(?:ing|ed)?\b",
            r"\barchitect(?:ure|ural|ing)?\b",
            r"\bwireframes?\b",
            r"\blayout\b",
            r"\bux\b",
            r"\bui design\b",
        ],
        "implementation": [
            r"\bbuild(?:ing|s|t)?\b",
            r"\bimplement(?:ation|ing|ed|s)?\b",
            r"\bdevelop(?:ment|ing|ed)?\b",
            r"\bcode(?:base|d|s|ing)?\b",
            r"\bcreate(?:d|s|ing)?\b",
        ],
        "audit": [
            r"\baudit(?:ing|ed|s)?\b",
            r"\breview(?:ing|ed|s)?\b",
            r"\binspect(?:ion|ing|ed|s)?\b",
            r"\bgap analysis\b",
            r"\bdefects?\b",
        ],
        "remediation": [
            r"\bfix(?:es|ed|ing)?\b",
            r"\bremediat(?:e|ed|es|ing|ion)\b",
            r"\bcorrect(?:ion|ed|ing|s)?\b",
            r"\brepair(?:ed|ing|s)?\b",
            r"\baddress(?:ed|ing)? (?:the )?(?:issue|finding|defect)",
        ],
        "verification": [
            r"\bverif(?:y|ied|ies|ication|ying)\b",
            r"\bvalidat(?:e|ed|es|ing|ion)\b",
            r"\bre-?tests?\b",
            r"\bconfirm(?:ed|ing|s|ation)?\b",
            r"\btests? pass(?:ed|es|ing)?\b",
        ],
        "packaging_release": [
            r"\bpackag(?:e|ed|ing)\b",
            r"\breleas(?:e|ed|ing)\b",
            r"\bdeploy(?:ed|ing|ment)?\b",
            r"\bpublish the (?:app|site|package)\b",
        ],
    },
    "context_modes": {
        "standards_constraints": [
            r"\bstandards?\b",
            r"\bguidelines?\b",
            r"\bpolic(?:y|ies)\b",
            r"\bprotocol\b",
            r"\brubric\b",
            r"\bcodebook\b",
            r"\bschema\b",
            r"\bacceptance criteria\b",
            r"\bconstraints?\b",
            r"\bAGENTS\.md\b",
            r"\bSKILL\.md\b",
        ],
        "bounded_package": [
            r"\bcontext package\b",
            r"\bdata stack\b",
            r"\bsource package\b",
            r"\battached (?:file|document|image|archive)s?\b",
            r"\buploaded (?:file|document|image|archive)s?\b",
            r"\bworkspace\b",
            r"\bworking directory\b",
            r"\brepository\b",
            r"\bcodebase\b",
        ],
        "multi_source_synthesis": [
            r"\bcross[- ]?reference\b",
            r"\btriangulat(?:e|ion|ing)\b",
            r"\breconcil(?:e|iation|ing)\b",
            r"\bsynthesi[sz](?:e|ing|s)\b",
            r"\bcompare (?:the |these )?(?:files|documents|sources|versions|stations|workstations)\b",
            r"\ball (?:three|3|files|documents|sources|stations|workstations)\b",
            r"\bmultiple (?:files|documents|sources|artifacts)\b",
        ],
        "just_in_time_retrieval": [
            r"\b(?:read|inspect|review|open|search|find|look through|audit|check)\b.{0,80}\b(?:file|folder|repo|repository|docs?|documents?|codebase|logs?|data|artifacts?|standards?|spec(?:ification)?s?)\b",
        ],
        "history_memory": [
            r"\bprevious conversation\b",
            r"\bearlier (?:conversation|work|session|task)\b",
            r"\bprior (?:conversation|work|session|task|context)\b",
            r"\bconversation history\b",
            r"\bmemory\b",
            r"\bresume (?:the|this)\b",
            r"\bcontinue from\b",
        ],
        "tool_environment": [
            r"\bMCP\b",
            r"\bplugin\b",
            r"\btool(?:ing|s)?\b",
            r"\bbrowser session\b",
            r"\bterminal\b",
            r"\benvironment state\b",
            r"\bworkstations?\b",
            r"\bstations? together\b",
        ],
        "examples_templates": [
            r"\bexamples?\b",
            r"\bexemplars?\b",
            r"\btemplates?\b",
            r"\breference implementation\b",
            r"\bfollow (?:the|this) pattern\b",
        ],
        "context_pruning_compaction": [
            r"\bcompact(?:ion|ed|ing)?\b",
            r"\bcontext window\b",
            r"\bprune (?:the )?context\b",
            r"\bremove irrelevant\b",
            r"\bretain only\b",
            r"\bsummari[sz]e (?:the )?(?:context|history|prior work)\b",
        ],
        "artifact_state_feedback": [
            r"\bcurrent state\b",
            r"\bworking tree\b",
            r"\bgit diff\b",
            r"\btest results?\b",
            r"\berror logs?\b",
            r"\bscreenshots?\b",
            r"\bexisting implementation\b",
            r"\breturned packages?\b",
        ],
    },
    "product_signals": [
        r"\bproduct\b",
        r"\bsoftware\b",
        r"\bapp(?:lication)?\b",
        r"\bwebsite\b",
        r"\bsite\b",
        r"\brepositor(?:y|ies)\b",
        r"\bcodebase\b",
        r"\bsource code\b",
        r"\binterface\b",
        r"\bUI\b",
        r"\bUX\b",
        r"\bcomponent\b",
        r"\bfeature\b",
        r"\bconfiguration\b",
        r"\btest suite\b",
        r"\bunit tests?\b",
        r"\bbug\b",
        r"\bdefect\b",
        r"\bissue\b",
        r"\bdeploy(?:ment|ed|ing)?\b",
        r"\brelease\b",
        r"\brequirements?\b",
        r"\bacceptance criteria\b",
        r"\boperational document\b",
        r"\bplatform\b",
        r"\bpackage\b",
    ],
    "continuation_only": [
        "^(?:ok(?:ay)?[,.! ]*)?(?:continue|proceed|go ahead|keep going|carry on|do it|done|yes)[.! ]*$",
        "^continue from where you left off[.! ]*$",
    ],
    "continuation_wrappers": [
        "^this session is being continued from a previous conversation",
        "^the summary below covers the earlier portion of the conversation",
        "^this is a continuation of a previous conversation",
    ],
    "delegated_prompt_candidates": [
        r"^you are (?:an? )?(?:audit |review |research |implementation |verification )?subagent\b",
        r"^you are subagent[ -]?[0-9]+\b",
        r"^you are reviewer [A-Z0-9]+ in (?:an? )?.*audit\b",
        r"\bsubagent [0-9]+ \((?:audit|review|implementation|verification)[^)]*\)",
    ],
    "tool_generated_prompts": [
        "^present_files:",
        "^tool_result:",
        "^function_call_output:",
        "^custom_tool_call_output:",
    ],
    "nonhuman_block_prefixes": [
        "<permissions instructions>",
        "<collaboration_mode>",
        "<environment_context>",
        "<app-context>",
        "<skills_instructions>",
        "<recommended_plugins>",
        "<multi_agent_mode>",
        "# model set context",
        "a different language model started to solve this problem",
    ],
}
