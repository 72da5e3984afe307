"""A training-data pipeline over ``documents``: language ID, line dedup,
near-duplicate removal, benchmark decontamination, source mixing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns what it keeps of ``docs``, with their own columns (the last adds
the mix's).  ``run`` writes each stage's result as Parquet in the shared
folder and reads it again for the next, so a stage that fails is repeated
from there and no plan spans two stages.

ORACLE_SQL is None: language profiles, MinHash candidates and alignment
scores are beyond SQL.  The stages are tested against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import decontam, langid, line_dedup, minhash, mixing
from sluice.llm.common import documents, materialize
from sluice.session import table

#: Near duplicates of the pipeline: five-word shingles, similarity 0.8.
SHINGLE, PERCENT = 5, 80

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters or text go, and long
    ones unlike all profiles.  Without labels all stay."""
    return langid.with_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds are taken out of the texts."""
    return line_dedup.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return minhash.one_of_each(docs, SHINGLE, PERCENT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how many words of each."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
