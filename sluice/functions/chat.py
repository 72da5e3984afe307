"""Chat payload handling: P3 flatten_chat, P4 input_payload, P5 assistant_text,
P6 output_payload, D5 segment_concat.

Two shapes are supported:

* nested requests (FIXTURES schema): ``messages`` ARRAY<STRUCT<role,
  content, parts>>, ``response.choices[].message`` - flattened with
  higher-order functions in the row, no shuffle;
* the long ``conversations`` table (one row per message) - one array per
  conversation, as a request carries its messages in one payload.  Where a
  message limit holds, messages are counted first (a partial aggregate) and
  a conversation above the limit keeps its count and no messages.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter
from unicodedata import normalize

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import is_ascii, is_blank, strip

PART_TYPE = "array<struct<type:string,text:string>>"
MESSAGE_TYPE = f"array<struct<role:string,content:string,parts:{PART_TYPE}>>"


@F.udf(returnType=T.ArrayType(T.StringType()), useArrow=False)  # see ``text``
def _canon_list_udf(texts: list[str | None] | None) -> list[str | None] | None:
    return None if texts is None else [None if t is None else normalize("NFC", t).strip() for t in texts]


def canon_list(arr: Column) -> Column:
    """NFC + strip of every element; all-ASCII arrays stay in the JVM."""
    all_ascii = F.forall(arr, lambda x: x.isNull() | is_ascii(x))
    slow = _canon_list_udf(F.when(~all_ascii, arr))
    return F.when(arr.isNull(), arr).when(all_ascii, F.transform(arr, strip)).otherwise(slow)


def message_segments(messages: Column) -> Column:
    """Raw text segments in message order: string content, or each text part
    (null text becomes the literal ``None``); null content adds nothing."""
    def per_message(m):
        parts = F.transform(F.filter(m["parts"], lambda p: p["type"] == "text"),
                            lambda p: F.coalesce(p["text"], F.lit("None")))
        return F.when(m["content"].isNotNull(), F.array(m["content"])) \
            .when(m["parts"].isNotNull(), parts).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(messages, per_message))


def join_segments(segs: Column) -> Column:
    """Non-empty segments joined by newline, then stripped."""
    return strip(F.array_join(F.filter(segs, lambda s: F.length(s) > 0), "\n"))


def flatten_chat(messages: Column) -> Column:
    """Canonical input text of a messages array."""
    return join_segments(canon_list(message_segments(messages)))


def input_messages(messages: Column, text: Column, role: Column) -> Column:
    """Messages, or a single message built from ``text`` (null when neither)."""
    single = F.array(F.struct(F.coalesce(role, F.lit("user")).alias("role"), text.alias("content"),
                              F.lit(None).cast(PART_TYPE).alias("parts")))
    blank = is_blank(text)
    return F.when(messages.isNotNull(), messages).when(~blank, single)


def assistant_text(response: Column) -> Column:
    """P5: string contents and text parts of every choice, joined, stripped."""
    msgs = F.transform(response["choices"], lambda c: c["message"])
    return join_segments(message_segments(msgs))


def output_text(response: Column, text: Column) -> Column:
    """``response`` wins over ``text``; null when nothing usable (malformed)."""
    from .text import normalize_text

    a = assistant_text(response)
    t_ok = ~is_blank(text)
    raw = F.when(response.isNotNull(), F.when(F.length(a) > 0, a)).when(t_ok, text)
    return normalize_text(raw)


def conversation_messages(conv: DataFrame, *, conv_id: str, turn: str, role: str, text: str,
                          max_messages: int | None = None) -> DataFrame:
    """Long table -> one row per conversation with its ordered message array
    and ``message_count``.  With a limit, conversations above it have null
    ``messages`` (the count gate makes them MALFORMED_INPUT)."""
    counts = conv.groupBy(conv_id).agg(F.count(F.lit(1)).alias("message_count"))
    bounded = conv
    if max_messages is not None:
        ok = counts.where(F.col("message_count") <= max_messages)
        bounded = conv.join(ok.select(conv_id), conv_id, "left_semi")
    msgs = bounded.groupBy(conv_id).agg(F.array_sort(F.collect_list(
        F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content")))).alias("_m"))
    msgs = msgs.select(conv_id, F.transform("_m", lambda m: F.struct(
        m["role"].alias("role"), m["content"].alias("content"),
        F.lit(None).cast(PART_TYPE).alias("parts"))).alias("messages"))
    return counts.join(msgs, conv_id, "left")


#: Characters of a piece of a transcript.
PIECE = 1 << 20


def segment_concat(df: DataFrame, *, key: str, order: str, text: str) -> DataFrame:
    """Ordered segments of one transcript joined with no separator, stripped.

    Two levels: rows are dealt by ranges of (key, order) and sorted there, and
    each range joins what it has of a key to pieces as it reads; then the few
    pieces of a key are joined.  So no task holds a long transcript as rows.
    Null segments are left out (a key of nothing else has an empty text); at
    equal orders segments come by their text; null orders come first.
    """
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(text).alias("t"))
    rows = rows.repartitionByRange("k", "o", "t").sortWithinPartitions("k", "o", "t").select("k", "t")

    def pieces(batches):
        part, n, cur, held, size = TaskContext.get().partitionId(), 0, None, [], 0
        kind = None

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([cur[0]], kind), pa.array([part], pa.int32()), pa.array([n], pa.int64()),
                                               pa.array(["".join(held)], pa.string())], ["k", "part", "n", "t"])
        for batch in batches:
            kind = batch.column(0).type
            for k, run in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), key=itemgetter(0)):
                if cur is not None and (cur[0] != k or size >= PIECE):
                    yield piece()
                    n, held, size = n + 1, [], 0
                cur = (k,)
                held.append("".join(t for _, t in run if t is not None))
                size += len(held[-1])
        if cur is not None:
            yield piece()

    schema = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("part", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("t", T.StringType())])
    g = rows.mapInArrow(pieces, schema).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("part", "n", "t"))).alias("s"))
    return g.select(F.col("k").alias(key), strip(F.array_join("s.t", "")).alias("text"))
