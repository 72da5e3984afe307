"""Output formats that results must reproduce exactly."""

# Decision detail messages and prefixes.
MSG_PHASE1_DISABLED = "phase1_disabled"
MSG_PHASE1_PASS = "phase1_pass"
MSG_RATE_LIMITED = "Too many requests for the current API key window"
MSG_INPUT_TOO_LONG = "Input exceeded max chars "
MSG_INPUT_TERMS = "Input matched blocklist terms: "
MSG_INPUT_PATTERN = "Input matched pattern "
MSG_STREAM_TOOLS = "Streaming requests allow fewer tools"
MSG_OUTPUT_TOO_LONG = "Output exceeded non-stream character limit"
MSG_OUTPUT_TERMS = "Output matched blocklist terms: "
MSG_ENFORCED = "Semantic guardrails enforced decision "
MSG_OBSERVED = "Semantic guardrails observed decision "
MSG_TIMEOUT = "Analyzer timeout observed for "
MSG_ALLOW = "guardrails_allow"
MSG_DIRECTION = "direction must be input or output"
MSG_NO_MESSAGES = "messages must be a non-empty array"
MSG_MANY_MESSAGES = "messages exceeds max count "
MSG_MANY_TOOLS = "tools exceeds max count "

# History action names and summaries per list and change kind;
# a summary ends with the added value or the entry id, replacements with nothing.
HISTORY = {
    ("blocklist", "add"): ("blocklist_entry_added", "Added blocklist term: "),
    ("blocklist", "update"): ("blocklist_entry_updated", "Updated blocklist entry "),
    ("blocklist", "delete"): ("blocklist_entry_deleted", "Deleted blocklist entry "),
    ("blocklist", "replace"): ("blocklist_replaced", "Replaced active blocklist"),
    ("prompt_patterns", "add"): ("prompt_pattern_added", "Added prompt pattern: "),
    ("prompt_patterns", "update"): ("prompt_pattern_updated", "Updated prompt pattern entry "),
    ("prompt_patterns", "delete"): ("prompt_pattern_deleted", "Deleted prompt pattern entry "),
    ("prompt_patterns", "replace"): ("prompt_patterns_replaced", "Replaced active prompt patterns"),
    ("golden_set", "add"): ("golden_set_entry_added", "Added golden set entry "),
    ("golden_set", "update"): ("golden_set_entry_updated", "Updated golden set entry "),
    ("golden_set", "delete"): ("golden_set_entry_deleted", "Deleted golden set entry "),
    ("golden_set", "replace"): ("golden_set_replaced", "Replaced active golden set"),
}
HISTORY_ACTIVATED = ("policy_activated", "policy", "Activated policy ", " version ")

# Counter names of the metrics exposition.
METRIC_REQUESTS = "guardrails_requests_total"
METRIC_BLOCKS = "guardrails_blocks_total"
METRIC_PHASE_HITS = "guardrails_phase_hits_total"
METRIC_FINAL_ACTIONS = "guardrails_final_actions_total"
METRIC_TIMEOUTS = "guardrails_analyzer_timeouts_total"
METRIC_RATE_LIMIT_HITS = "guardrails_rate_limit_hits_total"
METRIC_LATENCY_AVG = "guardrails_analyzer_latency_ms_avg"
AUDIT_LATENCY_FIELD = "guardrails_latency_ms"
