"""Policy version history as tables: V1 apply_changes, V2 replace_list,
V3 activate / create_policy, V4 history_filter, V5 version_diff,
W4 next_version, W5 latest_version, A7 policy_summary, J1-J3 resolution,
P7 normalize_entries, P8 coerce_settings, P9 merge_settings.

Two tables hold the edits instead of copy-on-write JSON:

* ``changes`` (policy_id, seq, ts, actor, action, list, lists, entry_id,
  value, pin): one row per change, ``seq`` distinct over all policies.  add,
  update and delete concern one entry of ``list``; replace sets all ``lists``
  anew; activate moves the active pointer to version ``pin`` (null: the
  policy's newest).
* ``entries`` (policy_id, seq, list, entry_id, value): what a replacement
  puts into its lists, none or any number.  A change made on an older base
  version is written as a replacement of every list that differs, with the
  base's entries; so an id can live again after its list was replaced.

Entries are validity intervals ``[valid_from, valid_to)`` in version numbers,
so a snapshot at version N is the filter ``valid_from <= N < valid_to``.
Acceptance needs no replay: a life of an entry starts with an add or a
replacement that holds it, and ends with the first delete in it or the next
replacement of its list.  Version numbers are a running count of accepted
changes.  Windows span one entry's events, or one range of one policy's
changes (see ``running``), never a whole policy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import formats as FMT
from ..functions.rules import term_entries
from ..functions.text import casefold, strip
from ..session import materialize
from ..settings import DEFAULTS, MUTABLE_FIELDS, field_kind
from .running import last_before, next_flagged, running_count

ENTRY_PREFIX = {"blocklist": "bl", "prompt_patterns": "pp", "golden_set": "gs"}
INF = 2**31 - 1
#: Order of what was there before a log starts.
BEFORE = -1


def _replacements(changes: DataFrame) -> DataFrame:
    """(policy_id, list, seq) of every list that a replacement sets anew."""
    return changes.where("action = 'replace'").select("policy_id", F.explode(F.array_distinct("lists")).alias("list"), "seq")


def entry_events(changes: DataFrame, entries: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(policy_id, list, entry_id, seq, event, value, since, life, swept,
    accepted): every event of every entry; ``event`` is start, update or delete,
    ``swept`` the next replacement of the entry's list.  Entries that were live
    before the log starts (``live``: policy_id, list, entry_id, value,
    valid_from) start at seq BEFORE and bring their version as ``since``."""
    none = F.lit(None).cast("bigint").alias("since")
    ev = changes.where("action in ('add', 'update', 'delete')").select(
        "policy_id", "list", "entry_id", "seq", F.when(F.col("action") == "add", "start").otherwise(F.col("action")).alias("event"), "value", none)
    ev = ev.unionByName(entries.select("policy_id", "list", "entry_id", "seq", F.lit("start").alias("event"), "value", none))
    if live is not None:
        ev = ev.unionByName(live.select("policy_id", "list", "entry_id", F.lit(BEFORE).cast("bigint").alias("seq"), F.lit("start").alias("event"), "value",
                                        F.col("valid_from").cast("bigint").alias("since")))
    ev = next_flagged(ev, ["policy_id", "list"], "seq", _replacements(changes), "swept")
    one = Window.partitionBy("policy_id", "list", "entry_id").orderBy("seq", "since")
    ev = ev.withColumn("life", F.sum((F.col("event") == "start").cast("int")).over(one.rowsBetween(Window.unboundedPreceding, 0)))
    life = Window.partitionBy("policy_id", "list", "entry_id", "life")
    start = F.col("event") == "start"
    ev = ev.withColumn("_end", F.min(F.when(start, F.col("swept"))).over(life)) \
        .withColumn("_del", F.min(F.when(F.col("event") == "delete", F.col("seq"))).over(life))
    before = lambda c: F.col(c).isNull() | (F.col("seq") < F.col(c))
    alive = (F.col("life") > 0) & before("_end")
    accepted = F.when(start, F.lit(True)).when(F.col("event") == "update", alive & before("_del")) \
        .otherwise(alive & (F.col("seq") == F.col("_del")))
    return ev.withColumn("accepted", accepted).drop("_end", "_del")


def accepted_of(changes: DataFrame, events: DataFrame, currents: DataFrame | None = None) -> DataFrame:
    """Adds ``accepted``, ``version`` of accepted edits (v1 = bootstrap) and
    ``current``, the policy's newest version once the change is done; counting
    goes on from ``currents`` (policy_id, current) where that is given.

    add, replace: always accepted; update, delete: the entry is alive;
    activate: the version it pins exists by then (a pointer move, no version).
    """
    ok = events.where("accepted and event <> 'start'").select("policy_id", "seq", F.lit(True).alias("_ok"))
    ch = changes.join(ok, ["policy_id", "seq"], "left")
    ch = ch.withColumn("_edit", F.col("action").isin("add", "replace") | F.coalesce("_ok", F.lit(False)))
    ch = running_count(ch, ["policy_id"], "seq", "_edit", "_n").withColumn("_first", F.lit(1).cast("bigint"))
    if currents is not None:
        ch = ch.drop("_first").join(currents.select("policy_id", F.col("current").alias("_first")), "policy_id", "left")
    ch = ch.withColumn("current", F.col("_n") + F.coalesce("_first", F.lit(1)))
    pinned = (F.col("action") == "activate") & (F.col("pin").isNull() | F.col("pin").between(F.lit(1), F.col("current")))
    return ch.withColumn("accepted", F.col("_edit") | pinned) \
        .withColumn("version", F.when(F.col("_edit"), F.col("current"))).drop("_ok", "_edit", "_n", "_first")


def intervals_of(events: DataFrame, accepted: DataFrame) -> DataFrame:
    """V1/V2: (policy_id, list, entry_id, value, valid_from, valid_to)."""
    ver = accepted.where("version is not null").select("policy_id", "seq", "version")
    ev = events.where("accepted").join(ver, ["policy_id", "seq"], "left").withColumn("version", F.coalesce("since", "version"))
    swept = ver.select("policy_id", F.col("seq").alias("swept"), F.col("version").alias("_swept_at"))
    ev = ev.join(swept, ["policy_id", "swept"], "left")
    life = Window.partitionBy("policy_id", "list", "entry_id", "life").orderBy("seq")
    ev = ev.withColumn("valid_to", F.coalesce(F.lead("version").over(life), F.col("_swept_at")))
    return ev.where("event <> 'delete'").select(
        "policy_id", "list", "entry_id", "value", F.col("version").alias("valid_from"), "valid_to")


def accept_changes(changes: DataFrame, entries: DataFrame) -> DataFrame:
    """``accepted_of`` a whole log."""
    return accepted_of(changes, entry_events(changes, entries))


def entry_intervals(changes: DataFrame, entries: DataFrame, accepted: DataFrame) -> DataFrame:
    """``intervals_of`` a whole log."""
    return intervals_of(entry_events(changes, entries), accepted)


def written_history(changes: DataFrame, entries: DataFrame, live: DataFrame | None = None,
                    currents: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, accepted, changes): the log is read once, and each later step
    reads what the step before wrote."""
    changes, entries = materialize(changes, "policy-log"), materialize(entries, "policy-log-entries")
    events = materialize(entry_events(changes, entries, live), "policy-events")
    return events, materialize(accepted_of(changes, events, currents), "policy-changes"), changes


def snapshot(intervals: DataFrame, versions: DataFrame) -> DataFrame:
    """Entries live at each (policy_id, at_version) of ``versions``."""
    j = intervals.join(versions, "policy_id")
    return j.where((F.col("valid_from") <= F.col("at_version"))
                   & (F.coalesce(F.col("valid_to"), F.lit(INF)) > F.col("at_version")))


def latest_versions(accepted: DataFrame) -> DataFrame:
    """Newest version per policy and number of versions (v1 included)."""
    n = F.max("current")
    return accepted.groupBy("policy_id").agg(n.alias("current_version"), n.alias("n_versions"))


def history_rows(accepted: DataFrame) -> DataFrame:
    """V4: one history row per accepted edit and per activation."""
    edit, policy, lead, tail = FMT.HISTORY_ACTIVATED
    pairs = lambda i: F.create_map(*(x for k, v in FMT.HISTORY.items() for x in (F.lit("|".join(k)), F.lit(v[i]))))
    key = F.concat_ws("|", F.coalesce(F.col("list"), F.get("lists", F.lit(0))), F.col("action"))
    moved = F.col("action") == "activate"
    version = F.when(moved, F.coalesce("pin", "current")).otherwise(F.col("version"))
    what = F.when(F.col("action") == "add", F.col("value")).when(F.col("action") == "replace", F.lit("")).otherwise(F.col("entry_id"))
    return accepted.where("accepted").select(
        F.concat(F.lit("hist_"), F.col("seq").cast("string")).alias("event_id"), F.col("ts").alias("timestamp"),
        "actor", "policy_id", version.alias("version"),
        F.when(moved, F.lit(edit)).otherwise(pairs(0)[key]).alias("action"),
        F.when(moved, F.lit(policy)).otherwise(F.coalesce(F.col("list"), F.get("lists", F.lit(0)))).alias("target"),
        F.when(moved, F.concat(F.lit(lead), F.col("policy_id"), F.lit(tail), version.cast("string")))
        .otherwise(F.concat(pairs(1)[key], what)).alias("summary"))


def history_filter(history: DataFrame, policy_id: str | None = None) -> DataFrame:
    return history if policy_id is None else history.where(F.col("policy_id") == policy_id)


def version_diff(intervals: DataFrame, pairs: DataFrame) -> DataFrame:
    """V5: entries added, removed or changed between the ``old`` and ``new``
    versions given per policy in ``pairs`` (policy_id, old, new): one pass, each
    interval says whether it is live at either."""
    j = intervals.join(pairs, "policy_id")
    live = lambda v: (F.col("valid_from") <= F.col(v)) & (F.coalesce(F.col("valid_to"), F.lit(INF)) > F.col(v))
    both = j.where(live("old") | live("new")).groupBy("policy_id", "list", "entry_id").agg(
        F.max(F.when(live("old"), F.col("value"))).alias("_old"), F.max(F.when(live("new"), F.col("value"))).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed") \
        .when(F.col("_old") != F.col("_new"), "changed")
    return both.select("policy_id", "list", "entry_id", change.alias("change")).where(F.col("change").isNotNull())


def active_pointer(accepted: DataFrame, initial_policy: str) -> DataFrame:
    """V3: the final (active_policy_id, active_version), one row: the last
    accepted activation's policy at the version it pins, or at that policy's
    newest version if the policy was edited since."""
    last = accepted.where("accepted and action = 'activate'").agg(
        F.max(F.struct("seq", "policy_id", F.coalesce("pin", "current").alias("at"))).alias("p"))
    last = last.select(F.coalesce("p.policy_id", F.lit(initial_policy)).alias("active_policy_id"),
                       F.coalesce("p.seq", F.lit(-1)).alias("_seq"), F.coalesce("p.at", F.lit(1)).alias("_at"))
    since = accepted.where("version is not null").select(F.col("policy_id").alias("active_policy_id"), F.col("seq").alias("_s"), "version")
    new = since.join(last, "active_policy_id").where("_s > _seq").agg(F.max("version").alias("_new"))
    return last.select("active_policy_id", F.coalesce(new.scalar(), F.col("_at")).alias("active_version"))


def policy_summary(accepted: DataFrame, pointer: DataFrame) -> DataFrame:
    """Id, current version, is_active and the active version."""
    pid, ver = (pointer.select(c).scalar() for c in ("active_policy_id", "active_version"))
    active = F.col("policy_id") == pid
    return latest_versions(accepted).select("policy_id", "current_version", active.alias("is_active"), F.when(active, ver).alias("active_version"))


def clone_policy(intervals: DataFrame, pointer: DataFrame, new_policy_id: str, existing: DataFrame) -> DataFrame:
    """V3 create_policy: the active snapshot becomes version 1 of a new
    policy; empty when the id already exists (409)."""
    at = pointer.select(F.col("active_policy_id").alias("policy_id"), F.col("active_version").alias("at_version"))
    taken = existing.where(F.col("policy_id") == new_policy_id).agg(F.count(F.lit(1))).scalar()
    return snapshot(intervals, at).where(taken == 0).select(
        F.lit(new_policy_id).alias("policy_id"), "list", "entry_id", "value",
        F.lit(1).cast("bigint").alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"))


# ------------------------------------------------------------------ resolution

def resolve_policy(req: DataFrame, policies: DataFrame, pointer: DataFrame) -> DataFrame:
    """Adds (status, applied_policy_id, applied_version) per request.

    Requests carry ``policy_id``, ``policy_version_text`` and, from their
    metadata, ``meta_policy_id`` and ``meta_version_text``; the body's own
    values win where they are there.  A version must be an integer (400); 0 or
    none means the policy's current version, except that with neither id nor
    version the *active* version applies.  Unknown policies and versions give
    404.  A policy's versions are 1..current_version, so one join by policy
    settles both; which side is broadcast, if any, is left to its size.
    """
    r = _asked(req).withColumns({"_apid": pointer.select("active_policy_id").scalar(), "_aver": pointer.select("active_version").scalar()})
    r = r.withColumn("_target", F.coalesce("_pid", "_apid"))
    r = r.join(policies.select(F.col("policy_id").alias("_target"), F.col("current_version").alias("_cur")), "_target", "left")
    return _settled(r)


def resolve_policy_at(req: DataFrame, accepted: DataFrame, initial_policy: str, as_of: str = "as_of") -> DataFrame:
    """J1 as of each request's own place in the log (column ``as_of``, compared
    with ``seq``): the pointer, and the versions there are, are those that the
    changes up to that place made.  Three as-of joins, split by ranges of the
    log, with the activations and twice with the accepted edits."""
    marks = accepted.withColumn(as_of, F.col("seq"))
    moved = marks.where("accepted and action = 'activate'").withColumn("at", F.coalesce("pin", "current"))
    made = marks.where("version is not null")
    r = last_before(_asked(req), [], as_of, moved.select(as_of, "policy_id", "seq", "at"), ["policy_id", "seq", "at"], "_act")
    r = r.withColumn("_apid", F.coalesce("_act.policy_id", F.lit(initial_policy)))
    newest = lambda key: made.select(F.col("policy_id").alias(key), as_of, "seq", "version")
    r = last_before(r, ["_apid"], as_of, newest("_apid"), ["seq", "version"], "_edit")
    since = F.col("_edit.seq") > F.coalesce("_act.seq", F.lit(BEFORE))
    r = r.withColumn("_aver", F.coalesce(F.when(since, F.col("_edit.version")), F.col("_act.at"), F.lit(1))).drop("_act", "_edit")
    r = r.withColumn("_target", F.coalesce("_pid", "_apid"))
    r = last_before(r, ["_target"], as_of, newest("_target"), ["version"], "_made")
    known = accepted.select(F.col("policy_id").alias("_target"), F.lit(1).cast("bigint").alias("_first")).distinct()
    r = r.join(known, "_target", "left").withColumn("_cur", F.when(F.col("_first").isNotNull(), F.coalesce("_made.version", "_first")))
    return _settled(r.drop("_made", "_first"))


def _asked(req: DataFrame) -> DataFrame:
    """``_pid``, ``_ver`` and ``_bad``: the policy and version a request names."""
    named = lambda c: F.when(F.length(strip(F.col(c))) > 0, strip(F.col(c)))
    text = F.coalesce("policy_version_text", "meta_version_text")
    version = strip(text).try_cast("int")
    return req.withColumns({"_pid": F.coalesce(named("policy_id"), named("meta_policy_id")), "_ver": version, "_bad": text.isNotNull() & version.isNull()})


def _settled(r: DataFrame) -> DataFrame:
    """Status and applied policy, from what was asked, the pointer (``_apid``,
    ``_aver``), the policy meant (``_target``) and its newest version (``_cur``)."""
    at = (F.when(F.col("_pid").isNull() & F.col("_ver").isNull(), F.col("_aver"))
          .when(F.col("_ver").isNull() | (F.col("_ver") == 0), F.col("_cur")).otherwise(F.col("_ver")))
    status = F.when(F.col("_bad"), 400).when(F.col("_cur").isNull() | ~at.between(F.lit(1), F.col("_cur")), 404).otherwise(200)
    r = r.withColumn("status", status)
    ok = F.col("status") == 200
    return r.withColumns({"applied_policy_id": F.when(ok, F.col("_target")), "applied_version": F.when(ok, at).cast("int")}) \
        .drop("_pid", "_ver", "_bad", "_apid", "_aver", "_target", "_cur")


def version_rules(intervals: DataFrame, versions: DataFrame, runtime_terms, runtime_patterns) -> DataFrame:
    """The rules of each (policy_id, version) of ``versions``: ``terms``
    (with casefold keys), ``patterns`` and ``golden``, in list order, and
    ``terms_from`` / ``patterns_from``.  An empty list of terms or patterns
    falls back to the runtime's; the golden set may be empty."""
    live = snapshot(intervals, versions.select("policy_id", F.col("version").alias("at_version")))
    item = F.struct("valid_from", "entry_id", "value")
    of = lambda name: F.sort_array(F.collect_list(F.when(F.col("list") == name, item)))
    got = live.groupBy("policy_id", F.col("at_version").alias("version")).agg(
        of("blocklist").alias("_b"), of("prompt_patterns").alias("_p"), of("golden_set").alias("_g"))
    rows = versions.select("policy_id", "version").join(got, ["policy_id", "version"], "left")
    values = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<valid_from:bigint,entry_id:string,value:string>>")), lambda x: x["value"])
    rows = rows.select("policy_id", "version", values("_b").alias("_b"), values("_p").alias("patterns"), values("_g").alias("golden"))
    # one casefold call over the distinct terms, not one per row of a version
    words = rows.select(F.explode("_b").alias("term")).distinct().withColumn("key", casefold(F.col("term")))
    keyed = rows.select("policy_id", "version", F.explode("_b").alias("term")).join(words, "term").groupBy("policy_id", "version").agg(
        F.sort_array(F.collect_set(F.struct("term", "key"))).alias("terms"))
    rows = rows.drop("_b").join(keyed, ["policy_id", "version"], "left")
    runtime = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(k).alias("key")) for t, k in term_entries(runtime_terms)))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    source = lambda c: F.when(some(c), "version").otherwise("runtime")
    return rows.select(
        "policy_id", "version", rule_fallback(F.col("terms"), runtime).alias("terms"),
        rule_fallback(F.col("patterns"), F.array(*map(F.lit, runtime_patterns))).alias("patterns"), "golden",
        source("terms").alias("terms_from"), source("patterns").alias("patterns_from"))


def rule_fallback(rules: Column, runtime: Column) -> Column:
    """An empty list in a version falls back to the runtime's list."""
    return F.when(F.coalesce(F.size(rules), F.lit(0)) > 0, rules).otherwise(runtime)


# ------------------------------------------------------------------ entries and settings

def entry_id_for(prefix: str, *parts: Column) -> Column:
    """Stable id: prefix + 12 hex chars of a SHA-256 over the entry's origin
    (the reference draws random ids; reruns here must be reproducible)."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 12))


def normalize_entries(df: DataFrame, *, list_name: str, value: str, given_id: str | None,
                      origin: list[str]) -> DataFrame:
    """Trim values, drop blank ones, keep a given id or mint a stable one."""
    v = strip(F.col(value))
    minted = entry_id_for(ENTRY_PREFIX[list_name], *[F.col(c).cast("string") for c in origin])
    gid = F.col(given_id) if given_id else F.lit(None).cast("string")
    out = df.withColumn("_v", v).where(F.col("_v").isNotNull() & (F.length("_v") > 0))
    return out.withColumn("entry_id", F.coalesce(F.when(F.length(gid) > 0, gid), minted)) \
        .withColumn(value, F.col("_v")).drop("_v")


def coerce_settings(df: DataFrame, *, field: str, value_json: str) -> DataFrame:
    """Validate one (field, JSON value) override per row.

    Adds ``value`` (canonical string) and ``error``.  bool fields need a
    JSON boolean; int fields a JSON integer (a boolean is accepted, as in
    the reference); float fields any JSON number (or boolean); str fields a
    JSON string; unknown fields are rejected.
    """
    kinds = F.create_map(*[x for f in MUTABLE_FIELDS for x in (F.lit(f), F.lit(field_kind(f)))])
    kind = kinds[F.col(field)]
    v = F.try_parse_json(F.col(value_json))
    t = F.schema_of_variant(v)
    is_bool = t == "BOOLEAN"
    is_int = t.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | t.startswith("DECIMAL(") & F.col(value_json).rlike(r"^\s*-?\d+\s*$")
    is_num = is_int | t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT")
    is_str = t == "STRING"
    ok = (F.when(kind == "bool", is_bool).when(kind == "int", is_int | is_bool)
          .when(kind == "float", is_num | is_bool).when(kind == "str", is_str).otherwise(False))
    err = (F.when(kind.isNull(), F.concat(F.lit("Unsupported setting field: "), F.col(field)))
           .when(~F.coalesce(ok, F.lit(False)),
                 F.concat(F.col(field), F.when(kind == "bool", F.lit(" must be a boolean"))
                          .when(kind == "int", F.lit(" must be an integer"))
                          .when(kind == "float", F.lit(" must be numeric"))
                          .otherwise(F.lit(" must be a string")))))
    bool_txt = F.when(F.variant_get(v, "$", "boolean"), F.lit("true")).otherwise(F.lit("false"))
    canon = (F.when(kind == "bool", bool_txt)
             .when(kind == "int", F.when(is_bool, F.when(F.variant_get(v, "$", "boolean"), "1").otherwise("0"))
                   .otherwise(F.variant_get(v, "$", "bigint").cast("string")))
             .when(kind == "float", F.when(is_bool, F.when(F.variant_get(v, "$", "boolean"), "1.0").otherwise("0.0"))
                   .otherwise(F.variant_get(v, "$", "double").cast("string")))
             .otherwise(F.variant_get(v, "$", "string")))
    return df.withColumn("error", err).withColumn("value", F.when(err.isNull(), canon))


def merge_settings(overrides: DataFrame, *, key: list[str], field: str, value: str, order: str,
                   base=DEFAULTS) -> DataFrame:
    """Base settings + per-key overrides of mutable fields (others ignored),
    as one typed struct per key.  The last override of a field wins; after
    that de-duplication a key holds at most one value per mutable field, so
    the collected map is bounded by the number of fields."""
    from ..settings import settings_struct_from_map

    last = overrides.where(F.col(field).isin(*MUTABLE_FIELDS)).groupBy(*key, field).agg(
        F.max_by(F.col(value), F.col(order)).alias("_val"))
    m = last.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(field), F.col("_val")))).alias("_ov"))
    return m.select(*key, settings_struct_from_map(base, F.col("_ov")).alias("settings"))
