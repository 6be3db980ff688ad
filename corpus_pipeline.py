"""A training corpus from the documents table: clean, deduplicate, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipcurate.llm import exact_dedup, mixing, packing, simhash, toxicity
from clipcurate.llm.common import materialize, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it learns from the labels of the training side."""
    scored = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col(scored.columns[-1])["predicted"] == 0).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a similarity of 0.8 or more (five-word shingles): that with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks: 1, 2, 3 in turn, three times at most."""
    return mixing.take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all tokens in sequences of 1024."""
    return packing.pack(docs)


STAGES = [("toxicity", reject_toxic), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]
#: SQL can express neither the classifier nor the rounding; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
