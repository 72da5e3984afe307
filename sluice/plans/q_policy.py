"""Policy-history queries.  The change log is derived from ``orders``:

* policy     = 'p' || (o_orderkey div 300)   (contiguous key ranges)
* seq, ts    = o_orderkey, o_orderdate;  actor = 'cust-' || o_custkey
* status F   -> add of a fresh entry <orderkey>
* status O   -> update of a nearby earlier entry
* status P   -> activation when o_totalprice < 20000 (pinned, in two of three,
  to version 1 + custkey mod 90, which may not exist), a replacement of a list
  when below 100000 (of the prompt patterns as well when below 50000) by
  custkey mod 3 entries, the second of which brings back an earlier id;
  otherwise a delete of a nearby earlier entry

An entry's number names its list (mod 3); the nearby target is
orderkey - 1 - floor(totalprice / 50000), so edits hit live, deleted, swept
and never-existing entries alike.  Values are words and patterns that occur
in the generated conversations.  The SQL side replays the log change by
change, with the live entries of a policy as its state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import DEFAULT_PATTERNS, DEFAULT_TERMS
from ..operators import policy as P
from ..operators.policy_log import PolicyLog
from ..session import materialize, scratch_path, table
from .chains import sql_casefold, sql_pii_count, sql_str
from .registry import register

LISTS = ("blocklist", "prompt_patterns", "golden_set")
PREFIXES = ("bl", "pp", "gs")
VALUES = (("nicht", "über", "with the", "token", "shall not occur"), (r"de\s+la", r"und\s+(?P<a>der|die)", r"never\s+seen"), ("g1", "g2"))


def _log(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    status, price, key, cust = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderkey"), F.col("o_custkey")
    action = (F.when(status == "F", "add").when(status == "O", "update").when(price < 20000, "activate")
              .when(price < 100000, "replace").otherwise("delete"))
    number = F.when(action == "add", key).otherwise(F.greatest(F.lit(0), key - 1 - F.floor(price / 50000))).cast("bigint")
    o = o.select(F.concat(F.lit("p"), F.floor(key / 300).cast("bigint").cast("string")).alias("policy_id"), key.alias("seq"),
                 F.col("o_orderdate").alias("ts"), F.concat(F.lit("cust-"), cust.cast("string")).alias("actor"), action.alias("action"),
                 number.alias("_n"), cust.alias("_cust"), price.alias("_price"))
    kind = (F.col("_n") % 3).cast("int")
    at = lambda names: F.get(F.array(*map(F.lit, names)), kind)
    value = F.get(F.get(F.array(*(F.array(*map(F.lit, v)) for v in VALUES)), kind),
                  (F.col("_cust") % F.get(F.array(*(F.lit(len(v)) for v in VALUES)), kind)).cast("int"))
    return o.withColumns({"_list": at(LISTS), "_id": F.concat(at(PREFIXES), F.lit("_"), F.col("_n").cast("string")), "_value": value})


def change_log(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(changes, entries) as ``operators.policy`` takes them."""
    o = _log(spark, sf)
    act = F.col("action")
    one = act.isin("add", "update", "delete")
    lists = F.when(F.col("_price") < 50000, F.array_distinct(F.array("_list", F.lit("prompt_patterns")))).otherwise(F.array("_list"))
    changes = o.select(
        "policy_id", "seq", "ts", "actor", "action", F.when(one, F.col("_list")).alias("list"),
        F.when(act == "replace", lists).alias("lists"), F.when(one, F.col("_id")).alias("entry_id"),
        F.when(act.isin("add", "update"), F.col("_value")).alias("value"),
        F.when((act == "activate") & (F.col("_cust") % 3 > 0), 1 + F.col("_cust") % 90).cast("bigint").alias("pin"))
    fresh = F.struct(F.concat(F.lit("r_"), F.col("seq").cast("string")).alias("entry_id"), F.lit("replaced").alias("value"))
    back = F.struct(F.col("_id").alias("entry_id"), F.col("_value").alias("value"))
    held = F.slice(F.array(fresh, back), F.lit(1), (F.col("_cust") % 3).cast("int"))
    entries = o.where("action = 'replace'").select("policy_id", "seq", F.col("_list").alias("list"), F.explode(held).alias("e"))
    return changes, entries.select("policy_id", "seq", "list", "e.entry_id", "e.value")


_VALUE_SQL = "[" + ", ".join("[" + ", ".join(sql_str(x) for x in v) + "]" for v in VALUES) + "][1 + n % 3]"
_REPLAY = f"""
WITH RECURSIVE log AS (
  SELECT *, 'p' || CAST(seq // 300 AS VARCHAR) AS policy_id, (['blocklist', 'prompt_patterns', 'golden_set'])[1 + n % 3] AS list,
         (['bl', 'pp', 'gs'])[1 + n % 3] || '_' || CAST(n AS VARCHAR) AS entry_id,
         ({_VALUE_SQL})[1 + cust % len({_VALUE_SQL})] AS value,
         row_number() OVER (PARTITION BY seq // 300 ORDER BY seq) AS rn,
         CASE WHEN action = 'activate' AND cust % 3 > 0 THEN 1 + cust % 90 END AS pin
  FROM (SELECT *, CASE WHEN action = 'add' THEN seq ELSE greatest(0, seq - 1 - CAST(floor(price / 50000) AS BIGINT)) END AS n
        FROM (SELECT o_orderkey AS seq, o_orderdate AS ts, 'cust-' || CAST(o_custkey AS VARCHAR) AS actor, o_custkey AS cust, o_totalprice AS price,
                     CASE WHEN o_orderstatus = 'F' THEN 'add' WHEN o_orderstatus = 'O' THEN 'update' WHEN o_totalprice < 20000 THEN 'activate'
                          WHEN o_totalprice < 100000 THEN 'replace' ELSE 'delete' END AS action FROM orders))
),
r AS (
  SELECT policy_id, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS seq, 'bootstrap' AS action, true AS accepted, CAST(1 AS BIGINT) AS version,
         CAST([] AS STRUCT(list VARCHAR, entry_id VARCHAR, value VARCHAR, since BIGINT)[]) AS live
  FROM log WHERE rn = 1
  UNION ALL
  SELECT policy_id, rn, seq, action, accepted, version + CASE WHEN accepted AND action <> 'activate' THEN 1 ELSE 0 END,
    CASE WHEN action = 'add' THEN list_append(live, {{'list': list, 'entry_id': entry_id, 'value': value, 'since': version + 1}})
         WHEN action = 'update' AND hit THEN list_append(list_filter(live, lambda e: NOT (e.list = list AND e.entry_id = entry_id)),
              {{'list': list, 'entry_id': entry_id, 'value': value, 'since': version + 1}})
         WHEN action = 'delete' AND hit THEN list_filter(live, lambda e: NOT (e.list = list AND e.entry_id = entry_id))
         WHEN action = 'replace' THEN list_concat(
              list_filter(live, lambda e: e.list <> list AND NOT (price < 50000 AND e.list = 'prompt_patterns')),
              list_slice([{{'list': list, 'entry_id': 'r_' || CAST(seq AS VARCHAR), 'value': 'replaced', 'since': version + 1}},
                          {{'list': list, 'entry_id': entry_id, 'value': value, 'since': version + 1}}], 1, cust % 3))
         ELSE live END
  FROM (SELECT l.policy_id, l.rn, l.seq, l.action, l.list, l.entry_id, l.value, l.price, l.cust, r.version, r.live,
               len(list_filter(r.live, lambda e: e.list = l.list AND e.entry_id = l.entry_id)) > 0 AS hit,
               CASE WHEN l.action IN ('add', 'replace') THEN true WHEN l.action = 'activate' THEN l.pin IS NULL OR l.pin <= r.version
                    ELSE len(list_filter(r.live, lambda e: e.list = l.list AND e.entry_id = l.entry_id)) > 0 END AS accepted
        FROM r JOIN log l ON l.policy_id = r.policy_id AND l.rn = r.rn + 1)
),
latest AS (SELECT policy_id, max(version) AS current_version FROM r GROUP BY policy_id),
at_version AS (SELECT policy_id, version, arg_max(live, rn) AS live FROM r GROUP BY ALL),
seen AS (SELECT policy_id, version, unnest(live, recursive := true) FROM at_version),
intervals AS (SELECT s.policy_id, list, entry_id, value, since AS valid_from,
                     CASE WHEN max(version) < any_value(current_version) THEN max(version) + 1 END AS valid_to
              FROM seen s JOIN latest USING (policy_id) GROUP BY s.policy_id, list, entry_id, value, since),
pointer AS (
  SELECT coalesce(a.policy_id, 'p0') AS active_policy_id,
         coalesce((SELECT max(version) FROM r WHERE r.policy_id = a.policy_id AND r.seq > a.seq AND r.accepted AND r.action <> 'activate'),
                  a.at, 1) AS active_version
  FROM (SELECT 1) LEFT JOIN (
    SELECT l.policy_id, l.seq, coalesce(l.pin, r.version) AS at FROM log l JOIN r ON r.policy_id = l.policy_id AND r.rn = l.rn
    WHERE l.action = 'activate' AND r.accepted ORDER BY l.seq DESC LIMIT 1) a ON true
)"""


def _accepted(spark, sf) -> DataFrame:
    """The log with what was accepted, written."""
    return P.written_history(*change_log(spark, sf))[1]


def policy_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(accepted, intervals), written once for queries that use them often."""
    events, accepted, _ = P.written_history(*change_log(spark, sf))
    return accepted, materialize(P.intervals_of(events, accepted), "policy-entries")


@register("apply_changes", sql=f"{_REPLAY} SELECT policy_id, list, entry_id, value, valid_from, valid_to FROM intervals")
def apply_changes(spark, sf):
    """V1: entry edits -> validity intervals per entry in version numbers."""
    events, accepted, _ = P.written_history(*change_log(spark, sf))
    return P.intervals_of(events, accepted)


@register("apply_batches", sql=f"{_REPLAY} SELECT policy_id, list, entry_id, value, valid_from, valid_to FROM intervals")
def apply_batches(spark, sf):
    """V1, V2, incremental: the log comes in five batches by seq, each merged
    into the stored intervals of the lists it names."""
    changes, entries = (materialize(x, "policy-log") for x in change_log(spark, sf))
    at = changes.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    log = PolicyLog(spark, scratch_path(spark, "policy-state"))
    for i in range(5):
        some = F.floor((F.col("seq") - (at.low or 0)) * 5 / ((at.high or 0) - (at.low or 0) + 1)) == i
        log.add(changes.where(some), entries.where(some))
    return log.intervals()


@register("replace_list", sql=f"""
{_REPLAY}
SELECT i.policy_id, list, valid_from AS version, count(*) AS n_entries, count(*) FILTER (starts_with(entry_id, 'r_')) AS n_fresh
FROM intervals i JOIN r ON r.policy_id = i.policy_id AND r.version = i.valid_from AND r.action = 'replace'
GROUP BY ALL
""")
def replace_list(spark, sf):
    """V2: what each whole-list replacement put into its list (none, one or
    two entries, some of them ids that lived before)."""
    events, accepted, _ = P.written_history(*change_log(spark, sf))
    made = accepted.where("action = 'replace'").select("policy_id", F.col("version").alias("valid_from"))
    return P.intervals_of(events, accepted).join(made, ["policy_id", "valid_from"]).groupBy(
        "policy_id", "list", F.col("valid_from").alias("version")).agg(
        F.count(F.lit(1)).alias("n_entries"), F.count_if(F.startswith("entry_id", F.lit("r_"))).alias("n_fresh"))


@register("next_version", sql=f"""
{_REPLAY} SELECT policy_id, seq, accepted, CASE WHEN accepted AND action <> 'activate' THEN version END AS version FROM r WHERE rn > 0
""")
def next_version(spark, sf):
    """Each accepted edit gets current + 1; rejected edits and activations
    get none."""
    return _accepted(spark, sf).select("policy_id", "seq", "accepted", "version")


@register("latest_version", sql=f"{_REPLAY} SELECT policy_id, current_version, current_version AS n_versions FROM latest")
def latest_version(spark, sf):
    """Newest version per policy and the number of versions."""
    return P.latest_versions(_accepted(spark, sf))


@register("history_filter", sql=f"""
{_REPLAY}
SELECT 'hist_' || CAST(l.seq AS VARCHAR) AS event_id, l.ts AS "timestamp", actor, l.policy_id,
  CASE WHEN l.action = 'activate' THEN coalesce(pin, version) ELSE version END AS version,
  CASE l.action WHEN 'activate' THEN 'policy_activated'
    WHEN 'replace' THEN list || '_replaced'
    ELSE CASE list WHEN 'blocklist' THEN 'blocklist_entry' WHEN 'prompt_patterns' THEN 'prompt_pattern' ELSE 'golden_set_entry' END
         || CASE l.action WHEN 'add' THEN '_added' WHEN 'update' THEN '_updated' ELSE '_deleted' END END AS action,
  CASE WHEN l.action = 'activate' THEN 'policy' ELSE list END AS target,
  CASE l.action WHEN 'activate' THEN 'Activated policy ' || l.policy_id || ' version ' || CAST(coalesce(pin, version) AS VARCHAR)
    WHEN 'replace' THEN CASE list WHEN 'blocklist' THEN 'Replaced active blocklist' WHEN 'prompt_patterns' THEN 'Replaced active prompt patterns'
                        ELSE 'Replaced active golden set' END
    WHEN 'add' THEN CASE list WHEN 'blocklist' THEN 'Added blocklist term: ' WHEN 'prompt_patterns' THEN 'Added prompt pattern: '
                    ELSE 'Added golden set entry ' END || value
    ELSE CASE l.action WHEN 'update' THEN 'Updated ' ELSE 'Deleted ' END || CASE list WHEN 'blocklist' THEN 'blocklist entry '
         WHEN 'prompt_patterns' THEN 'prompt pattern entry ' ELSE 'golden set entry ' END || entry_id END AS summary
FROM log l JOIN r ON r.policy_id = l.policy_id AND r.rn = l.rn WHERE accepted AND l.policy_id <> 'p1'
""")
def history_filter(spark, sf):
    """V4: the history, one row per version and per activation, of every policy
    but one, which ``policy.history_filter`` picks out to be left away."""
    h = P.history_rows(_accepted(spark, sf))
    return h.join(P.history_filter(h, "p1").select("event_id"), "event_id", "left_anti")


@register("version_diff", sql=f"""
{_REPLAY},
pairs AS (SELECT policy_id, current_version // 2 AS old, current_version AS new FROM latest),
o AS (SELECT i.policy_id, list, entry_id, value FROM intervals i JOIN pairs p ON p.policy_id = i.policy_id
      WHERE valid_from <= old AND coalesce(valid_to, 2147483647) > old),
n AS (SELECT i.policy_id, list, entry_id, value FROM intervals i JOIN pairs p ON p.policy_id = i.policy_id
      WHERE valid_from <= new AND coalesce(valid_to, 2147483647) > new)
SELECT coalesce(o.policy_id, n.policy_id) AS policy_id, coalesce(o.list, n.list) AS list,
       coalesce(o.entry_id, n.entry_id) AS entry_id,
       CASE WHEN o.value IS NULL THEN 'added' WHEN n.value IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL OUTER JOIN n ON o.policy_id = n.policy_id AND o.list = n.list AND o.entry_id = n.entry_id
WHERE o.value IS NULL OR n.value IS NULL OR o.value <> n.value
""")
def version_diff(spark, sf):
    """V5: per policy, entries added / removed / changed between the version
    half-way through its history and its current version."""
    events, acc, _ = P.written_history(*change_log(spark, sf))
    pairs = P.latest_versions(acc).select("policy_id", F.floor(F.col("current_version") / 2).alias("old"), F.col("current_version").alias("new"))
    return P.version_diff(P.intervals_of(events, acc), pairs)


@register("activate", sql=f"{_REPLAY} SELECT active_policy_id, active_version FROM pointer")
def activate(spark, sf):
    """V3: the final active pointer: the last activation that pinned a version
    there was, moved on by the policy's later versions."""
    return P.active_pointer(_accepted(spark, sf), initial_policy="p0")


@register("policy_summary", sql=f"""
{_REPLAY}
SELECT l.policy_id, l.current_version, l.policy_id = p.active_policy_id AS is_active,
       CASE WHEN l.policy_id = p.active_policy_id THEN p.active_version END AS active_version
FROM latest l, pointer p
""")
def policy_summary(spark, sf):
    """Per policy: current version, whether active, the active version."""
    acc = _accepted(spark, sf)
    return P.policy_summary(acc, P.active_pointer(acc, initial_policy="p0"))


# ------------------------------------------------------------------ J1-J3 on conversation requests

_REQ_SQL = _REPLAY + """,
req AS (
  SELECT conv_id, turn,
    CASE turn WHEN 1 THEN 'p1' WHEN 2 THEN 'p2' WHEN 3 THEN 'missing' WHEN 4 THEN '  ' END AS policy_id,
    CASE WHEN turn = 4 THEN 'p3' END AS meta_policy_id,
    CASE turn WHEN 2 THEN '2' WHEN 5 THEN '0' WHEN 6 THEN '900' WHEN 7 THEN 'abc' END AS policy_version_text,
    CASE WHEN turn = 4 THEN '5' WHEN turn = 2 THEN '7' WHEN turn = 1 AND conv_id % 2 = 0 THEN 'x' END AS meta_version_text
  FROM conversations
),
r1 AS (
  SELECT *, coalesce(nullif(trim(policy_id), ''), nullif(trim(meta_policy_id), '')) AS pid,
         coalesce(policy_version_text, meta_version_text) AS vt FROM req
),
r2 AS (
  SELECT r1.*, coalesce(pid, p.active_policy_id) AS tpid, TRY_CAST(trim(vt) AS INTEGER) AS v, latest.current_version AS cur, p.active_version AS aver
  FROM r1 CROSS JOIN pointer p LEFT JOIN latest ON latest.policy_id = coalesce(pid, p.active_policy_id)
),
r3 AS (
  SELECT *, CASE WHEN pid IS NULL AND v IS NULL THEN aver WHEN v IS NULL OR v = 0 THEN cur ELSE v END AS tver FROM r2
),
resolved AS (
  SELECT conv_id, turn, CASE WHEN vt IS NOT NULL AND v IS NULL THEN 400 WHEN cur IS NULL OR tver NOT BETWEEN 1 AND cur THEN 404 ELSE 200 END AS status,
    tpid, tver FROM r3
)"""


def _requests(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    t = F.col("turn")
    return c.select(
        "conv_id", "turn",
        F.when(t == 1, "p1").when(t == 2, "p2").when(t == 3, "missing").when(t == 4, "  ").alias("policy_id"),
        F.when(t == 4, "p3").alias("meta_policy_id"),
        F.when(t == 2, "2").when(t == 5, "0").when(t == 6, "900").when(t == 7, "abc").alias("policy_version_text"),
        F.when(t == 4, "5").when(t == 2, "7").when((t == 1) & (F.col("conv_id") % 2 == 0), "x").alias("meta_version_text"))


def _resolved(spark, sf):
    acc = _accepted(spark, sf)
    return P.resolve_policy(_requests(spark, sf), P.latest_versions(acc), P.active_pointer(acc, "p0"))


#: What a request resolves to as of its place in the log (``as_of``): with
#: ``asked`` (as_of, pid, vt, v and any others) before it, ``settled`` after it.
AS_OF_SQL = """
acts AS (SELECT l.policy_id, l.seq, coalesce(l.pin, r.version) AS pinned FROM log l JOIN r ON r.policy_id = l.policy_id AND r.rn = l.rn
         WHERE l.action = 'activate' AND r.accepted),
s1 AS (SELECT asked.*, (SELECT arg_max({'p': policy_id, 's': seq, 'pinned': pinned}, seq) FROM acts WHERE acts.seq <= asked.as_of) AS a FROM asked),
s2 AS (SELECT *, coalesce(pid, a.p, 'p0') AS tpid,
         coalesce((SELECT max(r.version) FROM r WHERE r.policy_id = coalesce(s1.a.p, 'p0') AND r.seq > coalesce(s1.a.s, -1) AND r.seq <= s1.as_of
                   AND r.accepted AND r.action <> 'activate'), a.pinned, 1) AS aver FROM s1),
s3 AS (SELECT *, (SELECT max(r.version) FROM r WHERE r.policy_id = s2.tpid AND r.seq <= s2.as_of) AS cur FROM s2),
s4 AS (SELECT *, CASE WHEN pid IS NULL AND v IS NULL THEN aver WHEN v IS NULL OR v = 0 THEN cur ELSE v END AS ver FROM s3),
settled AS (SELECT *, CASE WHEN vt IS NOT NULL AND v IS NULL THEN 400 WHEN cur IS NULL OR ver NOT BETWEEN 1 AND cur THEN 404 ELSE 200 END AS status FROM s4)"""

#: Requests come while the log is being written: each at its own place in it.
AS_OF = "conv_id * 37 + turn * 11"


@register("resolve_policy_at", sql=f"""
{_REQ_SQL},
asked AS (SELECT conv_id, turn, {AS_OF} AS as_of, pid, vt, TRY_CAST(trim(vt) AS INTEGER) AS v FROM r1),
{AS_OF_SQL.replace('settled AS', 'at_time AS')}
SELECT conv_id, turn, status, CASE WHEN status = 200 THEN tpid END AS applied_policy_id,
  CAST(CASE WHEN status = 200 THEN ver END AS INTEGER) AS applied_version FROM at_time
""")
def resolve_policy_at(spark, sf):
    """J1 as of the request's time: each request is judged under the pointer and
    the versions that there were at its place in the log."""
    requests = _requests(spark, sf).withColumn("as_of", F.expr(AS_OF))
    return P.resolve_policy_at(requests, _accepted(spark, sf), "p0").select("conv_id", "turn", "status", "applied_policy_id", "applied_version")


@register("resolve_policy", sql=f"""
{_REQ_SQL} SELECT conv_id, turn, status, CASE WHEN status = 200 THEN tpid END AS applied_policy_id,
  CAST(CASE WHEN status = 200 THEN tver END AS INTEGER) AS applied_version FROM resolved
""")
def resolve_policy(spark, sf):
    """Request-scoped policy and version (body, then metadata) else active;
    0 or no version = current, none at all = active version; 404 / 400 rows."""
    return _resolved(spark, sf).select("conv_id", "turn", "status", "applied_policy_id", "applied_version")


@register("version_lookup", sql=f"""
{_REQ_SQL}
SELECT conv_id, turn, CAST(tver AS INTEGER) AS version, coalesce(l.actor, 'system') AS created_by
FROM resolved LEFT JOIN r ON r.policy_id = tpid AND r.version = tver AND r.rn > 0 AND r.accepted AND r.action <> 'activate'
LEFT JOIN log l ON l.policy_id = r.policy_id AND l.seq = r.seq WHERE status = 200
""")
def version_lookup(spark, sf):
    """The version record each resolved request is judged under."""
    acc = _accepted(spark, sf)
    ver = acc.where("version is not null").select(
        F.col("policy_id").alias("applied_policy_id"), F.col("version").alias("applied_version"), "actor")
    resolved = P.resolve_policy(_requests(spark, sf), P.latest_versions(acc), P.active_pointer(acc, "p0"))
    return resolved.where("status = 200").join(ver, ["applied_policy_id", "applied_version"], "left").select(
        "conv_id", "turn", F.col("applied_version").cast("int").alias("version"), F.coalesce("actor", F.lit("system")).alias("created_by"))


def request_rules(resolved: DataFrame, intervals: DataFrame) -> DataFrame:
    """The rules of every version that a resolved request is judged under."""
    used = resolved.where("status = 200").select(F.col("applied_policy_id").alias("policy_id"), F.col("applied_version").alias("version")).distinct()
    return P.version_rules(intervals, used, DEFAULT_TERMS, DEFAULT_PATTERNS)


@register("rule_fallback", sql=f"""
{_REQ_SQL},
n AS (SELECT conv_id, turn, count(DISTINCT value) FILTER (i.list = 'blocklist') AS t, count(i.entry_id) FILTER (i.list = 'prompt_patterns') AS p,
             count(i.entry_id) FILTER (i.list = 'golden_set') AS g
      FROM resolved LEFT JOIN intervals i ON i.policy_id = tpid AND valid_from <= tver AND coalesce(valid_to, 2147483647) > tver
      WHERE status = 200 GROUP BY ALL)
SELECT conv_id, turn, CAST(CASE WHEN t > 0 THEN t ELSE {len(DEFAULT_TERMS)} END AS INTEGER) AS n_terms, CASE WHEN t > 0 THEN 'version' ELSE 'runtime' END AS terms_from,
       CAST(CASE WHEN p > 0 THEN p ELSE {len(DEFAULT_PATTERNS)} END AS INTEGER) AS n_patterns, CASE WHEN p > 0 THEN 'version' ELSE 'runtime' END AS patterns_from,
       CAST(g AS INTEGER) AS n_golden
FROM n
""")
def rule_fallback(spark, sf):
    """Each request's rules; a version with no terms or no patterns uses
    the runtime's, a version with no golden set has none."""
    accepted, intervals = policy_tables(spark, sf)
    resolved = P.resolve_policy(_requests(spark, sf), P.latest_versions(accepted), P.active_pointer(accepted, "p0"))
    resolved = materialize(resolved, "resolved")
    rules = request_rules(resolved, intervals).withColumnsRenamed({"policy_id": "applied_policy_id", "version": "applied_version"})
    return resolved.where("status = 200").join(rules, ["applied_policy_id", "applied_version"]).select(
        "conv_id", "turn", F.size("terms").alias("n_terms"), "terms_from", F.size("patterns").alias("n_patterns"), "patterns_from",
        F.size("golden").alias("n_golden"))


# ------------------------------------------------------------------ V6

_PINNED_SQL = f"""
{_REPLAY},
pins AS (SELECT doc_id, text, {sql_casefold('text')} AS key, l.policy_id, CAST(1 + current_version // 2 AS INTEGER) AS version_a, CAST(current_version AS INTEGER) AS version_b
         FROM documents JOIN latest l ON l.policy_id = 'p' || CAST(doc_id % 5 AS VARCHAR)),
used AS (SELECT DISTINCT policy_id, version_a AS v FROM pins UNION SELECT DISTINCT policy_id, version_b FROM pins),
rules AS (SELECT u.policy_id, u.v, list_distinct(list(value) FILTER (list = 'blocklist')) AS terms,
            list(value ORDER BY valid_from, entry_id) FILTER (list = 'prompt_patterns') AS pats
          FROM used u LEFT JOIN intervals i ON i.policy_id = u.policy_id AND valid_from <= v AND coalesce(valid_to, 2147483647) > v GROUP BY ALL),
j AS (SELECT pins.*, v, coalesce(terms, [{', '.join(sql_str(t) for t in DEFAULT_TERMS)}]) AS terms,
        coalesce(pats, [{', '.join(sql_str(t) for t in DEFAULT_PATTERNS)}]) AS pats
      FROM pins JOIN rules USING (policy_id) WHERE v IN (version_a, version_b)),
g AS (SELECT *, CASE WHEN length(text) > 12000 THEN 'INPUT_TOO_LONG'
                 WHEN len(list_filter(terms, lambda t: contains(key, {sql_casefold('t')}))) > 0 THEN 'BLOCKLIST_MATCH'
                 WHEN len(list_filter(pats, lambda p: regexp_matches(text, '(?i)' || p))) > 0 THEN 'PROMPT_INJECTION_PATTERN' END AS gate FROM j),
d AS (SELECT *, CASE WHEN gate IS NOT NULL THEN 'block' WHEN length(trim(text)) > 0 AND {sql_pii_count('text')} > 0 THEN 'observe' ELSE 'allow' END AS action,
        CASE WHEN gate IS NOT NULL THEN gate WHEN length(trim(text)) > 0 AND {sql_pii_count('text')} > 0 THEN 'PII_DETECTED' END AS reason FROM g)
SELECT a.doc_id, a.policy_id, a.version_a, a.version_b, a.action AS action_a, a.reason AS reason_a, b.action AS action_b, b.reason AS reason_b,
       a.action <> b.action AS changed
FROM d a JOIN d b ON a.doc_id = b.doc_id WHERE a.v = a.version_a AND b.v = b.version_b
"""


@register("pinned_replay", sql=_PINNED_SQL)
def pinned_replay(spark, sf):
    """V6: each text judged under two pinned versions of its policy, one half
    way through the policy's history and the current one, side by side.

    The rules of the versions come from the policy tables and are joined by
    (policy, version).  One scan of the texts; phase 1 depends on the version's
    rules, the analyzers don't, so they run once per row.
    """
    from ..operators.decide import Analyzers, Rules, final_action, phase1, phase2, phase3, text_features
    from ..settings import DEFAULTS, settings_struct
    from .chains import canon_docs

    accepted, intervals = policy_tables(spark, sf)
    current = P.latest_versions(accepted).select("policy_id", F.col("current_version").cast("int").alias("version_b"))
    pins = current.withColumn("version_a", (1 + F.floor(F.col("version_b") / 2)).cast("int"))
    asked = pins.select(F.lit(200).alias("status"), F.col("policy_id").alias("applied_policy_id"), F.explode(F.array("version_a", "version_b")).alias("applied_version"))
    rules = materialize(request_rules(asked, intervals), "pinned-rules")
    for side in ("a", "b"):
        pins = pins.join(rules.select("policy_id", F.col("version").cast("int").alias(f"version_{side}"), F.col("terms").alias(f"terms_{side}"),
                                      F.col("patterns").alias(f"patterns_{side}")), ["policy_id", f"version_{side}"])
    pins = materialize(pins, "pins")

    req = settings_struct(DEFAULTS)
    t, k = F.col("text"), F.col("key")
    d = canon_docs(spark, sf).withColumn("policy_id", F.concat(F.lit("p"), (F.col("doc_id") % 5).cast("string"))).join(pins, "policy_id")
    ids = ("doc_id", "policy_id", "version_a", "version_b")
    p1 = {v: phase1(t, k, F.lit(False), F.lit(0), F.lit(False), req, Rules(terms_col=f"terms_{v}", patterns_col=f"patterns_{v}")) for v in ("a", "b")}
    d = d.select(*ids, p1["a"].alias("p1_a"), p1["b"].alias("p1_b"), text_features(t, req, req, Analyzers()).alias("feat"))
    d = d.select(*ids, "p1_a", "p1_b", phase2(F.col("feat"), req, req, Analyzers()).alias("p2"))
    d = d.select(*ids, "p1_a", "p1_b", final_action(F.col("p2"), phase3(F.col("p2"), req), req).alias("fin"))
    out = []
    for v in ("a", "b"):
        blocked = F.col(f"p1_{v}.action") == "block"
        out += [F.when(blocked, F.col(f"p1_{v}.action")).otherwise(F.col("fin.action")).alias(f"action_{v}"),
                F.when(blocked, F.col(f"p1_{v}.reason_code")).otherwise(F.col("fin.reason_code")).alias(f"reason_{v}")]
    return d.select(*ids, *out).withColumn("changed", F.col("action_a") != F.col("action_b"))


# ------------------------------------------------------------------ P7-P9 on part

@register("normalize_entries", sql="""
SELECT p_brand AS policy_id, p_partkey AS pos,
       'bl_' || substr(sha256(p_brand || chr(1) || CAST(p_partkey AS VARCHAR)), 1, 12) AS entry_id, trim(p_name) AS term
FROM part WHERE p_size <= 48
""")
def normalize_entries(spark, sf):
    """Padded names become terms (trimmed); blank ones (size > 48 here)
    are dropped; ids are minted stably from the entry's origin."""
    p = table(spark, sf, "part")
    raw = p.select(F.col("p_brand").alias("policy_id"), F.col("p_partkey").alias("pos"),
                   F.when(F.col("p_size") <= 48, F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")))
                   .otherwise(F.lit("   ")).alias("term"))
    out = P.normalize_entries(raw, list_name="blocklist", value="term", given_id=None, origin=["policy_id", "pos"])
    return out.select("policy_id", "pos", "entry_id", "term")


_FIELD_OF_TYPE = {"ECONOMY": "max_input_chars", "SMALL": "phase2_enabled", "STANDARD": "toxicity_safe_threshold",
                  "PROMO": "phase3_mode", "MEDIUM": "rate_limit_max_requests"}


def _override_rows(spark, sf):
    p = table(spark, sf, "part")
    fmap = F.create_map(*[x for k, v in _FIELD_OF_TYPE.items() for x in (F.lit(k), F.lit(v))])
    field = F.coalesce(fmap[F.col("p_type")], F.concat(F.lit("unknown_"), F.lower("p_type")))
    s = F.col("p_size")
    value = (F.when(s < 15, s.cast("string")).when(s < 30, F.when(s % 2 == 0, "true").otherwise("false"))
             .when(s < 40, F.lit('"enforce"')).otherwise(F.col("p_retailprice").cast("string")))
    return p.select(F.col("p_brand").alias("policy_id"), F.col("p_partkey").alias("pos"), field.alias("field"),
                    value.alias("value_json"))


_OVERRIDE_SQL = """
ov AS (
  SELECT p_brand AS policy_id, p_partkey AS pos,
    coalesce(CASE p_type WHEN 'ECONOMY' THEN 'max_input_chars' WHEN 'SMALL' THEN 'phase2_enabled'
                         WHEN 'STANDARD' THEN 'toxicity_safe_threshold' WHEN 'PROMO' THEN 'phase3_mode'
                         WHEN 'MEDIUM' THEN 'rate_limit_max_requests' END, 'unknown_' || lower(p_type)) AS field,
    CASE WHEN p_size < 15 THEN CAST(p_size AS VARCHAR) WHEN p_size < 30 THEN CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END
         WHEN p_size < 40 THEN '"enforce"' ELSE CAST(p_retailprice AS VARCHAR) END AS value_json
  FROM part
),
kinds(field, kind) AS (VALUES ('max_input_chars', 'int'), ('phase2_enabled', 'bool'),
                             ('toxicity_safe_threshold', 'float'), ('phase3_mode', 'str'), ('rate_limit_max_requests', 'int')),
typed AS (
  SELECT ov.*, kinds.kind, json_type(value_json) AS jt FROM ov LEFT JOIN kinds ON kinds.field = ov.field
),
checked AS (
  SELECT *, CASE WHEN kind IS NULL THEN 'Unsupported setting field: ' || field
     WHEN kind = 'bool' AND jt <> 'BOOLEAN' THEN field || ' must be a boolean'
     WHEN kind = 'int' AND jt NOT IN ('UBIGINT', 'BIGINT', 'BOOLEAN') THEN field || ' must be an integer'
     WHEN kind = 'float' AND jt NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') THEN field || ' must be numeric'
     WHEN kind = 'str' AND jt <> 'VARCHAR' THEN field || ' must be a string' END AS error
  FROM typed
),
coerced AS (
  SELECT policy_id, pos, field, error,
    CASE WHEN error IS NOT NULL THEN NULL
         WHEN kind = 'bool' THEN value_json
         WHEN kind = 'int' THEN CASE WHEN jt = 'BOOLEAN' THEN CASE WHEN value_json = 'true' THEN '1' ELSE '0' END ELSE value_json END
         WHEN kind = 'float' THEN CASE WHEN jt = 'BOOLEAN' THEN CASE WHEN value_json = 'true' THEN '1.0' ELSE '0.0' END
                                  ELSE CAST(CAST(value_json AS DOUBLE) AS VARCHAR) END
         ELSE json_extract_string(value_json, '$') END AS value
  FROM checked
)"""


@register("coerce_settings", sql=f"WITH {_OVERRIDE_SQL} SELECT policy_id, pos, field, value, error FROM coerced")
def coerce_settings(spark, sf):
    """Type-check every override by the field's kind; unknown fields rejected."""
    out = P.coerce_settings(_override_rows(spark, sf), field="field", value_json="value_json")
    return out.select("policy_id", "pos", "field", "value", "error")


@register("merge_settings", sql=f"""
WITH {_OVERRIDE_SQL},
last AS (SELECT policy_id, field, arg_max(value, pos) AS value FROM coerced WHERE error IS NULL GROUP BY policy_id, field)
SELECT policy_id,
  coalesce(max(CASE WHEN field = 'max_input_chars' THEN CAST(value AS INTEGER) END), 12000) AS max_input_chars,
  coalesce(max(CASE WHEN field = 'phase2_enabled' THEN CAST(value AS BOOLEAN) END), true) AS phase2_enabled,
  coalesce(max(CASE WHEN field = 'toxicity_safe_threshold' THEN CAST(value AS DOUBLE) END), 0.3) AS toxicity_safe_threshold,
  coalesce(max(CASE WHEN field = 'phase3_mode' THEN value END), 'observe') AS phase3_mode,
  coalesce(max(CASE WHEN field = 'rate_limit_max_requests' THEN CAST(value AS INTEGER) END), 30) AS rate_limit_max_requests
FROM last GROUP BY policy_id
""")
def merge_settings(spark, sf):
    """Base settings + the last valid override per field, per policy."""
    ok = P.coerce_settings(_override_rows(spark, sf), field="field", value_json="value_json").where(F.col("error").isNull())
    m = P.merge_settings(ok, key=["policy_id"], field="field", value="value", order="pos")
    return m.select("policy_id", *[F.col(f"settings.{f}").alias(f) for f in
                                   ("max_input_chars", "phase2_enabled", "toxicity_safe_threshold", "phase3_mode",
                                    "rate_limit_max_requests")])
