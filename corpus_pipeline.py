"""From documents to packed training sequences: language, near-duplicates, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are stored and are the
next stage's docs. All but the last return the columns of ``documents``. A stage keeps what its
operator does not object to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guardframe.llm.common import fold, read
from guardframe.llm.decontaminate import without_leaks
from guardframe.llm.langid import in_language, train
from guardframe.llm.minhash import near_duplicates
from guardframe.llm.packing import pack
from guardframe.sources.scratch import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language or several; noise goes, and texts that are null or without a letter.

    Repeated rows and rows without id are judged like all others; an empty table stays empty, and without
    labelled rows nothing is recognised.
    """
    return in_language(docs, train(docs.where(fold("doc_id", 5) > 0), noise=True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest id.

    Of rows that repeat id and text, one stays. Documents without id are in no class and stay, and so do
    those without text, each in a class of its own. An empty table stays empty.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("id").alias("doc_id")).distinct()
    repeats = Window.partitionBy("doc_id", "text").orderBy("doc_id")
    nth = max(docs.columns, key=len) + "_nth"  # a name that no column has
    once = docs.join(kept, "doc_id", "left_semi").withColumn(nth, F.row_number().over(repeats)).where(F.col(nth) == 1)
    return once.select(docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``.

    Null and empty texts have none and stay, as do repeated rows and rows without id, each judged by its text.
    """
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of full sequences.

    Null text is empty and one piece, its end; repeated rows and rows without id are packed each. An empty
    table gives no pieces.
    """
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Neither the field, nor banding, alignment or token ids can be said in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
