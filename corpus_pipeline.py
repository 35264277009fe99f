"""A training-corpus pipeline over ``documents``: stages that each read what their predecessor kept.

All stages but the last return the columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shotlattice.llm import jaccard, mixing, outliers, packing, repeats
from shotlattice.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    Null and empty texts have no words and are rejected; null languages and sources are groups of their own; texts of any length are read whole; repeated rows are judged each for itself, so equal rows stay or go
    together; an empty table stays empty. All columns pass, whatever their names.
    """
    return outliers.accepted(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Texts without words are like nothing and stay; null ids come after all others; of rows that tie in id one stays if they are near-duplicates; texts of any length are compared whole; an empty table stays
    empty. All columns pass.
    """
    return jaccard.representatives(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes of strings of 200 bytes that repeat; n_chars follows the text.

    A passage of 50 words has 309 bytes at the median, and over 240 in 99 of 100 places of the texts; 400 bytes would let nearly all of them pass.
    Null texts become empty; empty ones stay; repeated rows lose what they repeat like any others; texts of any length are read whole; an empty table stays empty. Columns keep their order.
    """
    others = tuple(c for c in docs.columns if c != "text")
    cut = repeats.unrepeated(docs, keep=others, as_text=True, window=repeats.MARK)
    return cut.select(*[F.col("kept").alias(c) if c == "text" else F.length("kept").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null texts have no words; null sources are one source, after all others; rows that tie are ordered by a hash of themselves, so reruns agree, and repeated rows count each for itself; an empty table stays empty. All
    columns pass.
    """
    return mixing.drawn(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document that is left: null and empty texts are one end token, texts of any length are cut, repeated rows are packed each for itself, an empty table gives no pieces."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", ngram_jaccard), ("suffix-array dedup", repeat_removal), ("mixing", source_mix), ("packing", sequence_packing)]

#: SQL can express neither the robust estimates nor the packing; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on the documents of ``sf_dir``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
