"""Documents made ready for training: known language, no near copies, no repeats, packed.

Each stage gets the rows its predecessor kept, as a table in the shared folder,
and calls one operator of ``dueline.llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dueline.llm import langid, packing, simhash, substrings
from dueline.llm._support import staged
from dueline.llm.queries import WORD_LEVEL

#: Least score of a predicted language, and languages that stay (None: all learned ones).
LEAST_SCORE = 0.3
WANTED: list[str] | None = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told.

    Those without letters go, those whose predicted language has a score below
    ``LEAST_SCORE``, and, if ``WANTED`` names languages, those predicted as another.
    """
    return langid.with_known_language(docs, langid.train(docs), least=LEAST_SCORE, wanted=WANTED)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id."""
    return simhash.one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 200 bytes that stand elsewhere as well."""
    return substrings.cleaned(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.packed(docs, WORD_LEVEL)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("packing", pack),
]

#: Learned languages, fingerprints and packing are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
