"""From raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.decontaminate import drop_contaminated
from tablewright.llm.exact_dedup import drop_exact_copies
from tablewright.llm.language_id import keep_identified
from tablewright.llm.near_dedup import keep_one_of_each
from tablewright.llm.packing import pack
from tablewright.llm.registry import END_ID, WINDOW_TOKENS, table, vocabulary
from tablewright.llm.shared import ship_package, written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language cannot be told, go."""
    ship_package(spark)
    return keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, a similarity of 0.8 or more; one document of each group stays."""
    ship_package(spark)
    return keep_one_of_each(docs, percent=80, n=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pack(docs, vocabulary(), WINDOW_TOKENS, END_ID)


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("packing", pack_windows),
]

#: No SQL has the tokenizer's ids, the trained network or the signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
