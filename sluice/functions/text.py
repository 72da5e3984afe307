"""Text canonicalisation (P1 normalize_text, P2 casefold_key).

Spark has no NFC or full-casefold builtin, so one UDF returns both the
canonical text (NFC, then Unicode strip) and its casefold key in a single pass.
Pure-ASCII rows are not sent to Python: for them NFC is the identity, casefold
equals ASCII lower-casing and Unicode strip equals stripping the ASCII
whitespace set, all of which Catalyst evaluates in whole-stage codegen.  The
UDF input is nulled for those rows because a CASE does not stop a Python UDF
from being called.

UDFs on whole texts are plain ones, not Arrow's: a Python worker then holds the
hundred rows that Spark pickles at a time, where an Arrow batch may hold 10,000
texts or 64 MB, several times over once it is turned into objects and back.
"""

from __future__ import annotations

from unicodedata import normalize

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters for which Python's str.isspace() is true.
WHITESPACE = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
              "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_ASCII_ONLY = r"^[\x00-\x7F]*$"


@F.udf(returnType=T.StructType([T.StructField("text", T.StringType()), T.StructField("key", T.StringType())]), useArrow=False)
def _canon_udf(s: str | None) -> tuple[str | None, str | None]:
    if s is None:
        return None, None
    text = normalize("NFC", s).strip()
    return text, text.casefold()


@F.udf(returnType=T.StringType(), useArrow=False)
def _casefold_udf(s: str | None) -> str | None:
    return None if s is None else s.casefold()


def strip(col: Column) -> Column:
    """Python's ``str.strip()``.  A trim by a character list reads each end
    once; a regex anchored at the end would start anew at every blank inside."""
    return F.btrim(col, F.lit(WHITESPACE))


def is_ascii(col: Column) -> Column:
    return col.rlike(_ASCII_ONLY)


def canon(col: Column) -> Column:
    """STRUCT<text, key>: NFC + Unicode strip, and the casefold of that."""
    ascii_row = is_ascii(col)
    slow = _canon_udf(F.when(~ascii_row, col))
    fast_text = strip(col)
    return F.when(col.isNull(), F.lit(None).cast("struct<text:string,key:string>")).when(
        ascii_row, F.struct(fast_text.alias("text"), F.lower(fast_text).alias("key"))
    ).otherwise(slow)


def normalize_text(col: Column) -> Column:
    return canon(col).getField("text")


def casefold(col: Column) -> Column:
    """Full Unicode casefold (``ß`` -> ``ss``), not ``lower``."""
    return F.when(is_ascii(col), F.lower(col)).otherwise(_casefold_udf(F.when(~is_ascii(col), col)))


def is_blank(col: Column) -> Column:
    """Python ``not s.strip()``."""
    return col.isNull() | (strip(col) == "")
