"""Operations data: W2 restart_budget, W3 failure_streak, A6 probe_summary,
D2 probe_verdict, P10 rate_key and the helpers they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.timecols import epoch_micros
from .ratelimit import rate_limit

# Watchdog defaults.
COOLDOWN_SECONDS = 120
MAX_RESTARTS_PER_HOUR = 6
HOUR_SECONDS = 3600
HEALTH_FAIL_THRESHOLD = 3


def restart_budget(requests: DataFrame, *, key: str, ts: str, order_id: str,
                   cooldown_seconds: int = COOLDOWN_SECONDS, max_per_hour: int = MAX_RESTARTS_PER_HOUR) -> DataFrame:
    """``allowed`` per restart request; refused requests leave no trace.

    The same admitted-only fold as W1 (window one hour, cap per hour) plus
    the cooldown since the last admitted restart.
    """
    out = rate_limit(requests, key=key, ts=ts, order_id=order_id, window_seconds=HOUR_SECONDS,
                     max_requests=max_per_hour, cooldown_seconds=cooldown_seconds)
    return out.withColumn("allowed", ~F.col("limited")).drop("limited")


def failure_streak(ticks: DataFrame, *, key: str, ts: str, order_id: str, fail: str,
                   threshold: int = HEALTH_FAIL_THRESHOLD) -> DataFrame:
    """Consecutive failures; every ``threshold``-th one fires and resets.

    A failure's number is the running count of failures less that count at the
    last success; it fires when the number is a multiple of the threshold -
    the reset after firing makes the counter periodic, whether or not the
    restart was allowed.  Both running values are split by day: one row per
    (key, day) carries them over, and windows span one key's day at most.
    """
    t = ticks.withColumn("_day", F.floor(epoch_micros(ticks, ts) / 86_400_000_000))
    day = Window.partitionBy(key, "_day").orderBy(ts, order_id).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_f", F.sum(F.col(fail).cast("int")).over(day))
    t = t.withColumn("_s", F.max(F.when(~F.col(fail), F.col("_f"))).over(day))
    per = t.groupBy(key, "_day").agg(F.max("_f").alias("_n"), F.max("_s").alias("_last"))
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    per = per.withColumn("_since", F.coalesce(F.max(F.col("_before") + F.col("_last")).over(before), F.lit(0)))
    t = t.join(per.select(key, "_day", "_before", "_since"), [key, "_day"])
    number = F.when(F.col("_s").isNotNull(), F.col("_f") - F.col("_s")).otherwise(F.col("_before") + F.col("_f") - F.col("_since"))
    return t.withColumn("fired", F.col(fail) & (number % threshold == 0)).drop("_day", "_f", "_s", "_before", "_since")


def probe_summary(results: DataFrame, *, run: str, passed: str) -> DataFrame:
    """PASS / FAIL counts per run."""
    return results.groupBy(run).agg(
        F.count_if(F.col(passed)).alias("pass_count"), F.count_if(~F.col(passed)).alias("fail_count"))


def json_has_key(body: Column, key: Column) -> Column:
    """Key present at any depth of a JSON document.

    ``to_json`` of a VARIANT is minified and escapes quotes inside strings,
    so an object key is exactly a ``{"key":`` or ``,"key":`` occurrence.
    """
    j = F.to_json(F.try_parse_json(body))
    return F.coalesce(
        (F.instr(j, F.concat(F.lit('{"'), key, F.lit('":'))) > 0)
        | (F.instr(j, F.concat(F.lit(',"'), key, F.lit('":'))) > 0),
        F.lit(False))


def is_json_object(body: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False))


def error_message(body: Column) -> Column:
    """The message of a JSON object's ``error``: an object's non-empty
    ``message`` or else the object itself, anything else as text ("None" for
    JSON null); "" without one."""
    v = F.try_parse_json(body)
    err = F.try_variant_get(v, "$.error", "variant")
    kind = F.schema_of_variant(err)
    inner = F.try_variant_get(v, "$.error.message", "string")
    has = is_json_object(body) & F.coalesce(F.array_contains(F.json_object_keys(body), "error"), F.lit(False))
    text = (F.when(kind.startswith("OBJECT"), F.when(F.length(inner) > 0, inner).otherwise(F.to_json(err)))
            .when(kind == "VOID", F.lit("None"))
            .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$.error", "string")))
            .otherwise(F.try_variant_get(v, "$.error", "string")))
    return F.when(has, F.coalesce(text, F.lit("None"))).otherwise(F.lit(""))


def probe_verdict(df: DataFrame, *, code: str, body: str, expect_key: str) -> DataFrame:
    """Code != 200 -> FAIL; an error message in the JSON -> FAIL with that
    message; expected key found -> PASS, else FAIL."""
    b = F.col(body)
    message = error_message(b)
    has_error = message != ""
    found = json_has_key(b, F.col(expect_key))
    verdict = F.when(F.col(code) != 200, "FAIL").when(has_error, "FAIL").when(found, "PASS").otherwise("FAIL")
    reason = (F.when(F.col(code) != 200, F.concat(F.lit("http "), F.col(code).cast("string")))
              .when(has_error, F.concat(F.lit("error payload: "), message))
              .when(found, F.lit(None).cast("string"))
              .otherwise(F.concat(F.lit("missing key: "), F.col(expect_key))))
    return df.withColumn("verdict", verdict).withColumn("reason", reason)


def rate_key(explicit: Column, api_key: Column, host: Column) -> Column:
    """P10: explicit non-blank key (stripped), else API key, else host, else anonymous."""
    e = strip(explicit)
    return F.coalesce(F.when(F.length(e) > 0, e), F.when(F.length(api_key) > 0, api_key),
                      F.when(F.length(host) > 0, host), F.lit("anonymous"))


# ------------------------------------------------------------------ D1, D3, D4, O2, J7, P12

def kv_upsert(base: DataFrame, updates: DataFrame, *, key: str, value: str, line_no: str, order: str) -> DataFrame:
    """KEY=VALUE upsert.  Every line of an updated key takes the last
    update's value; absent keys are appended.  Reads: last match (``tail
    -n1``) and first match.  Both sides are pre-aggregated per key before
    the full outer join, so a hot key costs one row."""
    b = base.groupBy(key).agg(F.max_by(value, line_no).alias("_last"), F.min_by(value, line_no).alias("_first"),
                              F.count(F.lit(1)).alias("_n"))
    u = updates.groupBy(key).agg(F.max_by(value, order).alias("_upd"))
    j = b.join(u, key, "full_outer")
    return j.select(key, F.coalesce("_upd", "_last").alias("last_value"), F.coalesce("_upd", "_first").alias("first_value"),
                    F.coalesce("_n", F.lit(1)).cast("bigint").alias("n_lines"),
                    F.when(F.col("_n").isNull(), "appended").when(F.col("_upd").isNotNull(), "updated")
                    .otherwise("kept").alias("status"))


def payload_kind(body: Column) -> Column:
    """D3: classify a response body by its leading bytes."""
    b = body.cast("binary")
    head4, head3 = F.hex(F.substring(b, 1, 4)), F.hex(F.substring(b, 1, 3))
    as_text = b.cast("string")
    err = error_message(as_text) != ""
    return (F.when(b.isNull() | (F.length(b) == 0), "empty").when(err, "json_error")
            .when(head4 == "52494646", "wav").when(head3 == "494433", "mp3").otherwise("other"))


def log_lines(df: DataFrame, *, service: str, doc: str, text: str) -> DataFrame:
    """Split texts into (service, doc, line_idx, line)."""
    return df.select(service, doc, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_idx", "line"))


def log_scan(lines: DataFrame, *, service: str, pattern: str, order: list[str]) -> DataFrame:
    """Case-insensitive regex per service -> hit count, fail flag and the
    last matched text (``max_by`` over line order).  A service whose lines
    hold no hit is reported as passed, with a null match."""
    hit = F.col("line").rlike(f"(?i){pattern}")
    m = F.when(hit, F.regexp_extract(F.col("line"), f"(?i){pattern}", 0))
    return lines.groupBy(service).agg(
        F.count_if(hit).alias("hit_lines"), F.max_by(m, F.when(hit, F.struct(*order))).alias("last_match")) \
        .withColumn("failed", F.col("hit_lines") > 0)


def first_log_hits(lines: DataFrame, *, service: str, pattern: str, order: list[str], k: int = 20) -> DataFrame:
    """O2: first ``k`` matching lines per service.  ``row_number() <= k`` is
    planned as a window group limit: each task keeps its own first k per
    service before the shuffle, so a hot service ships only k rows per task."""
    w = Window.partitionBy(service).orderBy(*order)
    return lines.where(F.col("line").rlike(f"(?i){pattern}")).withColumn("rn", F.row_number().over(w)) \
        .where(F.col("rn") <= k)


def new_keys_only(existing: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Insert candidates whose key is absent (409 otherwise)."""
    fresh = candidates.join(existing.select(key), key, "left_anti")
    return existing.withColumn("source", F.lit("existing")).unionByName(fresh.withColumn("source", F.lit("inserted")))


# Generation request limits.
GEN_RULES = (
    ("prompt_length", "length(prompt) < 1 OR length(prompt) > 2000"),
    ("negative_prompt_length", "negative_prompt IS NOT NULL AND length(negative_prompt) > 2000"),
    ("height_range", "height < 256 OR height > 768"),
    ("width_range", "width < 256 OR width > 768"),
    ("steps_range", "num_inference_steps < 1 OR num_inference_steps > 50"),
    ("guidance_range", "guidance_scale < 0.0 OR guidance_scale > 20.0"),
    ("num_images_range", "num_images < 1 OR num_images > 2"),
    ("response_format", "NOT (response_format RLIKE '^(b64_json)$')"),
)


def validate_generation(df: DataFrame) -> DataFrame:
    """Every violated rule, as an array of rule names (empty = valid)."""
    checks = [F.when(F.expr(cond), F.lit(name)) for name, cond in GEN_RULES]
    return df.withColumn("violations", F.array_compact(F.array(*checks)))
