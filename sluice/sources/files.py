"""File sources: S1 load_terms (phrase lists), S2 load_rules (JSON rule
documents), S6 latest_run_files (probe run directories)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import DEFAULT_PATTERNS, DEFAULT_TERMS
from ..functions.text import strip

#: Files Spark's writers leave beside the data.
WRITER_MARKERS = ("_SUCCESS", "_committed", "_started")


def term_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """S1 rule over any line table: strip, drop blank and ``#`` comment lines."""
    s = strip(F.col(line))
    return lines.withColumn("term", s).where((F.length("term") > 0) & ~F.col("term").startswith("#"))


def load_terms(spark: SparkSession, path: str) -> DataFrame:
    """Read a phrase file (one per line); an empty result falls back to the
    runtime defaults.  ``pos`` keeps file order."""
    raw = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    terms = term_lines(raw).select("pos", "term")
    defaults = spark.createDataFrame(list(enumerate(DEFAULT_TERMS)), "pos long, term string")
    return terms.unionByName(defaults.where(terms.agg(F.count(F.lit(1))).scalar() == 0))


def rules_from_json(doc: Column) -> Column:
    """S2 rule over a JSON document column: invalid JSON or a non-object ->
    fallback {}; a missing ``prompt_injection_patterns`` key -> the four
    defaults; a present key -> its list (possibly empty)."""
    v = F.try_parse_json(doc)
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    keys = F.when(is_obj, F.json_object_keys(doc))
    has_key = F.coalesce(F.array_contains(keys, "prompt_injection_patterns"), F.lit(False))
    given = F.try_variant_get(v, "$.prompt_injection_patterns", "array<string>")
    defaults = F.array(*[F.lit(p) for p in DEFAULT_PATTERNS])
    return F.when(has_key, F.coalesce(given, F.array().cast("array<string>"))).otherwise(defaults)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Read a JSON rules file (whole file = one document)."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(rules_from_json(F.col("value")).alias("prompt_injection_patterns"))


def latest_run_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of the run directory under ``root`` that was written last: the
    one with the newest file, at equal times the larger name.  ``binaryFile``
    lists and reads in parallel; only names and times are read to find the run,
    a one-row aggregate that is joined back."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_extract(F.col("path"), r"^.*/([^/]+)/([^/]+)$", 1), "^[^=/]+=", "")
    name = F.regexp_extract(F.col("path"), r"^.*/([^/]+)/([^/]+)$", 2)
    f = files.select(rel.alias("run_id"), name.alias("file"), "length", "content", "modificationTime")
    f = f.where(~F.col("file").isin(*WRITER_MARKERS) & ~F.col("file").rlike(r"^[.].*[.]crc$"))
    newest = f.agg(F.max_by("run_id", F.struct("modificationTime", "run_id")).alias("run_id"))
    return f.join(F.broadcast(newest), "run_id", "left_semi")
