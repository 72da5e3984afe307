"""Operator 9: URL filter by path-template tree (DataFrame functions only).

Per host the paths form a tree of segments, of any depth.  Segments that look
variable (numbers, long hex, ids with digits) become wildcards at once; so
does every child of a branch point with many children and few pages for each.
The tree is built a level at a time; a path that is alone below a branch point
takes its rest as one segment, so there are as many levels as branch points.

Branches are merged level by level from the leaves up to the host.  At each
branch point those whose labelled bad rate differs significantly from that of
their siblings are split off, first on the side that differs most, then again
among the rest; the others, and all without labels, become one branch, which
is compared with its own siblings in turn.  A branch that is split off is
judged by itself, with all that was merged into it: its purity is smoothed
towards the rate of its siblings (its parent without it) and of the whole
corpus.  What reaches the host is smoothed towards the corpus only.
Everything is
a partial aggregation on (host, path prefix): one row per template and not per
page reaches the comparisons, so a hot host costs no more than others.

Fixed rules come first: host suffix and path prefix, the longest fitting rule
wins.

Defined cases: a null url, or one without "://", has empty host and path and
gets the method's verdict for that (empty) template; repeated rows are judged
alike; a null label is unlabelled; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: (host, path prefix, verdict) of the base.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Segments that are wildcards at once: digits (with an extension), long hex or
#: uuid-like strings, words that end in several digits.
VARIABLE = r"^([0-9]+([.][A-Za-z0-9]+)?|[0-9a-fA-F-]{16,}|[^0-9]*[0-9]{3,}.*)$"
#: A branch point with this many children and fewer pages for each than
#: MIN_PAGES_PER_CHILD is variable.
MANY_CHILDREN, MIN_PAGES_PER_CHILD = 20, 3
#: Branches within this many standard errors of their siblings' rate are merged.
MERGE_Z = 1.96
#: Pseudo-counts of the smoothing, and the smoothed bad rate that rejects.
PRIOR_WEIGHT, REJECT_AT = 10, 0.5


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The path's segments, generalised; empty ones are left out."""
    some = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(some, lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))


def path_templates(found: DataFrame) -> DataFrame:
    """``found``: one row per (host, segs) with counts ``pages``, ``n`` and
    ``bad``.  Adds ``t``: the segments with variable branch points made
    wildcards, from the top down.  A path that ends where others go on has ''
    as its last one; one that is alone has its rest as one."""
    live, done, i = found.withColumn("t", F.array().cast("array<string>")), None, 0
    while True:
        seg = F.get("segs", F.lit(i))
        child = live.groupBy("host", "t", F.coalesce(seg, F.lit("")).alias("s")).agg(F.sum("pages").alias("_n"))
        wide = child.groupBy("host", "t").agg(F.count(F.lit(1)).alias("_k"), F.sum("_n").alias("_all"))
        wide = wide.where((F.col("_k") >= MANY_CHILDREN) & (F.col("_all") < MIN_PAGES_PER_CHILD * F.col("_k")))
        out = live.join(wide.select("host", "t", F.lit(True).alias("_wide")), ["host", "t"], "left")
        step = F.when(seg.isNull(), F.lit("")).when(F.col("_wide"), F.lit("*")).otherwise(seg)
        out = out.withColumn("t", F.concat("t", F.array(step))).withColumn("_end", seg.isNull()).drop("_wide")
        out = materialize(out, "url-level")
        alone = out.groupBy("host", "t").agg(F.count(F.lit(1)).alias("_k")).where("_k = 1").select("host", "t", F.lit(True).alias("_alone"))
        out = out.join(alone, ["host", "t"], "left")
        i += 1
        rest = F.array_join(F.concat(F.slice("t", i, 1), F.slice("segs", i + 1, F.greatest(F.size("segs") - i, F.lit(0)))), "/")
        t = F.when(F.col("_end") | F.col("_alone").isNull(), F.col("t")).otherwise(F.concat(F.slice("t", 1, i - 1), F.array(rest)))
        out = materialize(out.select(*found.columns, t.alias("t"), (F.col("_end") | F.col("_alone").isNotNull()).alias("_done")), "url-level")
        ended = out.where("_done").drop("_done")
        done, live = ended if done is None else done.union(ended), out.where("not _done").drop("_done")
        if live.isEmpty():
            return done


def _smooth(bad: Column, n: Column, up: Column) -> Column:
    return (bad + PRIOR_WEIGHT * up) / (n + PRIOR_WEIGHT)


def split_off(level: DataFrame, base: Column) -> DataFrame:
    """``level``: branches (host, up, n, bad, ..) by their parent ``up``.  Adds
    ``out``: whether a branch differs from the siblings that stay."""
    level = materialize(level.withColumn("out", F.lit(False)), "url-merge")
    while True:
        rest = level.where("not out").groupBy("host", "up").agg(F.sum("n").alias("_n"), F.sum("bad").alias("_b"))
        c = level.join(rest, ["host", "up"])
        p, rn = _smooth(F.col("_b"), F.col("_n"), base), F.col("_n") - F.col("n")
        z = (F.col("bad") / F.col("n") - (F.col("_b") - F.col("bad")) / rn) / F.sqrt(p * (1 - p) * (1 / F.col("n") + 1 / rn))
        c = c.withColumn("_z", F.when(~F.col("out") & (F.col("n") > 0) & (rn > 0), F.round(z, 9)).otherwise(F.lit(0.0))).drop("_n", "_b")
        sides = c.groupBy("host", "up").agg(F.max("_z").alias("_hi"), F.min("_z").alias("_lo")).where(F.greatest("_hi", -F.col("_lo")) > MERGE_Z)
        sides = materialize(sides, "url-sides")
        if sides.isEmpty():
            return level
        c = c.join(sides, ["host", "up"], "left")
        new = F.when(F.col("_hi") >= -F.col("_lo"), F.col("_z") > MERGE_Z).otherwise(F.col("_z") < -MERGE_Z)
        level = materialize(c.withColumn("out", F.col("out") | (F.col("_hi").isNotNull() & new)).drop("_z", "_hi", "_lo"), "url-merge")


def template_verdicts(templates: DataFrame) -> DataFrame:
    """``templates``: one row per (host, t) with n and bad counts of labelled
    pages.  Adds ``bad_rate``, by merging from the leaves up."""
    templates = materialize(templates, "url-tree")
    whole = templates.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max(F.size("t")).alias("depth")).first()
    base = F.lit(((whole["bad"] or 0) + 1) / ((whole["n"] or 0) + 2))
    finals = up = None
    for depth in range(whole["depth"] or 0, 0, -1):
        level = templates.where(F.size("t") == depth).select("host", "t", "n", "bad")
        level = split_off((level if up is None else level.union(up)).withColumn("up", F.slice("t", 1, depth - 1)), base)
        parents = level.groupBy("host", "up").agg(F.sum("n").alias("_pn"), F.sum("bad").alias("_pb"))
        siblings = _smooth(F.col("_pb") - F.col("bad"), F.col("_pn") - F.col("n"), base)
        final = level.where("out").join(parents, ["host", "up"]).select("host", "t", _smooth(F.col("bad"), F.col("n"), siblings).alias("bad_rate"))
        finals = final if finals is None else finals.union(final)
        up = level.where("not out").groupBy("host", F.col("up").alias("t")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    if up is None:
        return templates.withColumn("bad_rate", base)
    finals = finals.union(up.select("host", "t", _smooth(F.col("bad"), F.col("n"), base).alias("bad_rate")))
    # a template's verdict is that of the nearest branch above it that was split off, or its host's
    at = templates.select("host", "t", F.explode(F.sequence(F.lit(0), F.size("t"))).alias("_d")).withColumn("_at", F.slice(F.col("t"), F.lit(1), F.col("_d")))
    found = at.join(finals.withColumnRenamed("t", "_at"), ["host", "_at"])
    return found.groupBy("host", "t").agg(F.max_by("bad_rate", "_d").alias("bad_rate"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """``pages``: page_id, url; ``labels``: key, bad (any number of rows a
    key).  A page's label is that of the number its last path segment holds.
    Returns ``page_id, host, path, rule, template, bad_rate, verdict``."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    key = F.expr("try_cast(nullif(regexp_extract(path, '([0-9]{1,18})[^/0-9]*/?$', 1), '') as bigint)")
    p = p.select("*", key.alias("_key"), segments(F.col("path")).alias("segs"))
    one = labels.groupBy(F.col("key").alias("_key")).agg(F.max("bad").alias("bad")).where("_key is not null")
    labelled = p.select("_key", "host", "segs").join(one, "_key", "left")
    found = labelled.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("bad"))
    found = path_templates(materialize(found, "url-templates"))
    judged = template_verdicts(found.groupBy("host", "t").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    judged = found.select("host", "segs", "t").join(judged, ["host", "t"])
    template = F.concat(F.lit("/"), F.array_join(F.filter("t", lambda s: s != ""), "/"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return p.join(judged, ["host", "segs"]).select(
        "page_id", "host", "path", name.alias("rule"), template.alias("template"), "bad_rate",
        F.coalesce(verdict, F.when(F.col("bad_rate") >= REJECT_AT, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )
