"""From raw documents to packed training sequences, stage by stage.

Each stage gets what its predecessor kept, written as Parquet and read again, and returns documents with all their columns
(`n_chars` stays that of the raw text); the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import decontamination, langid, near_copies, packing, pii
from loomwork.llm.common import cut
from loomwork.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that look like one of the languages learned; texts without letters or like none of them go."""
    ship(spark)
    model = langid.train(docs, langid.F.lit(True))
    got = langid.predict(docs, model)
    return got.where(~langid.F.col(got.columns[-1])).select(*(langid.F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    ship(spark)
    return near_copies.one_of_each(docs, words=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that reveal it replaced by labels."""
    return pii.clean(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    ship(spark)
    return packing.pack_documents(docs, capacity=1024, end_id=2)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("remove_pii", remove_pii), ("pack", pack)]

#: Fingerprints, models and packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
