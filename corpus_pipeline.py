"""From raw documents to packed training sequences in five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradewind.llm import exact, language, mixing, neardup, packing, queries
from tradewind.llm.shared import batches_by_bytes, settled


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is settled. The model is fitted on labelled rows of the stage's own input."""
    batches_by_bytes(spark)
    model = language.fit_language_model(docs, "text", "lang", "doc_id")
    return language.drop_unidentified(docs, model, declared=F.col("lang"), hosts=(F.col("source"),))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    batches_by_bytes(spark)
    return exact.drop_exact_duplicates(docs, exact.half_of())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each connected group of near copies."""
    batches_by_bytes(spark)
    return neardup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights; a document may stand there once, twice or not at all."""
    return mixing.take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    batches_by_bytes(spark)
    return packing.pack_sequences(docs, **queries.TOKENIZER)


STAGES = [
    ("language identification", identify),
    ("exact deduplication", drop_copies),
    ("near deduplication", drop_near_copies),
    ("source mixing", mix),
    ("packing", pack),
]

#: Signatures, language likelihoods and token ids are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage stored on its way goes once its result is written."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
