"""S3 parse_requests: JSON request bodies -> typed rows, malformed kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT_PARTS = "array<struct<type:string,text:string>>"


def _variant(df: DataFrame, col: str) -> DataFrame:
    out = df.withColumn("_v", F.try_parse_json(F.col(col)))
    is_obj = F.coalesce(F.schema_of_variant(F.col("_v")).startswith("OBJECT"), F.lit(False))
    return out.withColumn("malformed", ~is_obj)


def parse_json_column(df: DataFrame, col: str, schema: T.StructType | str) -> DataFrame:
    """Add ``parsed`` (a struct of ``schema``, a StructType or its DDL) and
    ``malformed`` (not JSON, or not a JSON object).  Parsing happens once, into
    a VARIANT; a field of another type than asked for is null by itself."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = _variant(df, col)
    parsed = F.struct(*(F.try_variant_get(F.col("_v"), f"$['{f.name}']", f.dataType.simpleString()).alias(f.name)
                        for f in schema.fields))
    return out.withColumn("parsed", F.when(~F.col("malformed"), parsed)).drop("_v")


def _message(m: Column) -> Column:
    """One message: role, string content, or the parts of a list content."""
    content = F.try_variant_get(m, "$.content", "variant")
    kind = F.schema_of_variant(content)
    return F.struct(
        F.try_variant_get(m, "$.role", "string").alias("role"),
        F.when(kind == "STRING", F.try_variant_get(m, "$.content", "string")).alias("content"),
        F.when(kind.startswith("ARRAY"), F.try_variant_get(m, "$.content", _TEXT_PARTS)).alias("parts"))


def parse_check_requests(df: DataFrame, col: str) -> DataFrame:
    """Add ``request``, the body of a check call: ``messages`` (role, content,
    parts), ``text``, ``role``, ``tool_count``, ``stream``, ``rate_key``,
    ``policy_id``, ``policy_version_text``, ``meta_policy_id``,
    ``meta_version_text`` and ``metadata``; and ``malformed`` as above."""
    out = _variant(df, col)
    v = F.col("_v")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    of = lambda path: F.schema_of_variant(get(path, "variant"))
    request = F.struct(
        F.transform(get("$.messages", "array<variant>"), _message).alias("messages"),
        F.when(of("$.text") == "STRING", get("$.text", "string")).alias("text"),
        F.coalesce(get("$.role", "string"), F.lit("user")).alias("role"),
        F.coalesce(F.size(get("$.tools", "array<variant>")), F.lit(0)).alias("tool_count"),
        F.coalesce(get("$.stream", "boolean"), F.lit(False)).alias("stream"),
        F.when(of("$.rate_key") == "STRING", get("$.rate_key", "string")).alias("rate_key"),
        F.when(of("$.policy_id") == "STRING", get("$.policy_id", "string")).alias("policy_id"),
        get("$.policy_version", "string").alias("policy_version_text"),
        F.when(of("$.metadata.policy_id") == "STRING", get("$.metadata.policy_id", "string")).alias("meta_policy_id"),
        get("$.metadata.policy_version", "string").alias("meta_version_text"),
        get("$.metadata", "map<string,string>").alias("metadata"),
    )
    return out.withColumn("request", F.when(~F.col("malformed"), request)).drop("_v")
