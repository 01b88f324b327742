"""From raw documents to packed training sequences, stage by stage.

Each stage reads what the one before it has written and works on all of it. All but the last return the columns
of ``documents``; the last returns the places of token pieces in sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm import language, minhash, mixing, packing, radix
from auditframe.llm.common import WORD, documents
from auditframe.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents whose most probable language is less probable than this are rejected, with those that have no letter.
LEAST_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the documents in which no language is recognised; the network learns from the stage's labelled rows."""
    judged = language.identify(docs, language.learn(docs))
    return judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of equal texts."""
    return radix.groups_of_equals(docs).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles, and all rows without an id."""
    found = minhash.near_duplicates(docs)
    dropped = found.filter("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document as many times as the mixture takes it."""
    mixed = mixing.mix(docs, F.regexp_count("text", F.lit(WORD)))
    return mixed.select(*docs.columns, "copies").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token pieces of every row and their places in full sequences."""
    return packing.packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixture", mixture),
    ("packed", packed),
]

#: The network, the near-duplicates' candidates and the packing are beyond SQL; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages, from the documents of ``folder``; each but the last is written before the next one starts."""
    docs = documents(spark, folder)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
