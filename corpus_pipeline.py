"""From raw documents to packed training sequences.

Each stage calls one operator of sedimenta.llm, works on all that its predecessor kept, and returns
the columns of documents, whatever they are; from mixing on with the training position, and the last
returns the packing.  Between stages the documents are a Parquet table in the shared folder, so a
lost executor repeats tasks of one stage only; a table goes when its reader is done.

Null and empty texts pass all stages up to mixing, which takes none of them.  Rows without an id are
never near duplicates of others.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm import jaccard_join, mixing, packing, suffix_dedup, toxicity
from sedimenta.llm.tables import Scratch, bounded_batches, read

#: The column in which mixing hands positions to packing.
POSITION = "training_position"


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    bounded_batches(spark)
    return toxicity.keep_clean(docs, toxicity.learn(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    bounded_batches(spark)
    return jaccard_join.keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds."""
    bounded_batches(spark)
    return suffix_dedup.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order, each copy with its position."""
    return mixing.mixed(docs, place=POSITION)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: the pieces of every document with their bins, in training order by blocks."""
    return packing.pack_documents(docs, place=POSITION)


STAGES = [("toxicity", clean), ("jaccard_join", distinct), ("suffix_dedup", unrepeated), ("mixing", mixed), ("packing", packed)]

#: No SQL: learned scores, similarity components and byte-string removal are not expressible; tests/llm hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, scratch, before = read(spark, sf_dir, "documents"), Scratch(spark), []
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = [name]
    return STAGES[-1][1](spark, docs, sf_dir)
