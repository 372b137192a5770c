"""The corpus pipeline: stages that each take and return documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.llm import cnn, minhash_dedup, packing, quality_rules, suffix_dedup
from alertlake.llm.frames import own_ids, residue, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows that models may learn from; the others are held out."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(residue("doc_id", 4) != 2)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network scores below its threshold go."""
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cnn.keep_good(docs, cnn.train(corpus, training_labels(spark, sf_dir)))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the boosted trees go."""
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules.keep_good(docs, quality_rules.fit(corpus, training_labels(spark, sf_dir)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; rows without an id all stay.

    Rows that share an id but are several texts count one by one, so that no text goes of which there is no near copy.
    """
    rows = own_ids(docs, "doc_id", "_row")
    named = rows.where("doc_id IS NOT NULL")
    gone = minhash_dedup.near_duplicates(named.select("_row", "text"), "_row", percent=minhash_dedup.NEAR_PERCENT).where("NOT kept")
    return rows.join(gone.select(F.col("doc_id").alias("_row")), "_row", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document holds are cut out; n_chars follows the text."""
    cut = suffix_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of words in which no source and no near copy occurs twice: one row per document or part of a long one."""
    return packing.pack(packing.sized(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("near copies", near_copies),
    ("repeated passages", repeated_passages),
    ("packing", pack),
]

# Classifiers, trees and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage reads what the one before has stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for index, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if index < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
