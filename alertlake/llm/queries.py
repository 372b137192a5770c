"""The queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.llm import cnn, embedding_dedup, html_text, importance, language, minhash_dedup, packing, periodic, pieces, pii, quality_rules, suffix_dedup, warc
from alertlake.llm.frames import id_text, residue

# Folder of public vocabulary files; the setting alertlake.tokenizers names another one.
TOKENIZERS = "/opt/tokenizers"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf, "documents"))


def damaged_pages(pages: DataFrame) -> DataFrame:
    """A replica with known damage: some pages lost, some cut short, some with one character changed."""
    page = F.col("page_id")
    html = (
        F.when(page % 211 == 3, F.expr("substring(html, 1, length(html) - 7)"))
        .when(page % 101 == 7, F.concat(F.lit("#"), F.expr("substring(html, 2)")))
        .otherwise(F.col("html"))
    )
    return pages.where(F.coalesce(page % 307 != 11, F.lit(True))).withColumn("html", html)


def op2_warc_audit(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    trees = [warc.fixity_tree(warc.records(replica)) for replica in (pages, damaged_pages(pages))]
    return warc.audit(*trees)


def op3_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = pieces.read_vocabulary(f"{spark.conf.get('alertlake.tokenizers', TOKENIZERS)}/piece_bpe_32k.model")
    return pieces.encode(id_text(table(spark, sf, "documents"), "doc_id", "text"), vocabulary).drop("text")


def op4_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf, "embeddings"))


def op5_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf, "pages"))


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = id_text(table(spark, sf, "documents"), "doc_id", "text")
    labels = table(spark, sf, "labels").where(residue("doc_id", 4) != 2)
    return quality_rules.assess(docs, quality_rules.fit(docs, labels)).drop("text")


def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(residue("doc_id", 3) != 1))
    texts = docs.select("doc_id", F.coalesce(residue("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text")
    return language.identify(texts, model).drop("text")


def op8_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf, "documents"))


def op9_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = id_text(table(spark, sf, "documents"), "doc_id", "text")
    net = cnn.train(docs, table(spark, sf, "labels").where(residue("doc_id", 4) != 2))
    texts = docs.select("doc_id", F.coalesce(residue("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return cnn.classify(texts, net).drop("text")


def op10_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.sized(table(spark, sf, "documents")))


def op11_contextual_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf, "documents")))


def op12_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periodic.summary(periodic.collapse(periodic.looped(table(spark, sf, "documents"))))


def all_queries() -> dict[str, Query]:
    named = [op1_minhash_dedup, op2_warc_audit, op3_sentencepiece, op4_embedding_dedup, op5_html_extraction, op6_quality_rules, op7_language_id, op8_suffix_dedup, op9_quality_classifier, op10_best_fit_packing, op11_contextual_pii, op12_importance_resampling, op13_periodic_runs]
    return {query.__name__: query for query in named}
