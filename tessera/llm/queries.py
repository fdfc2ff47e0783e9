"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup, fill_middle, hard_negatives, language_id, license_scan, mixing, order_minhash, packing, progressive_jpeg, quality_trees, url_reputation, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_matrices(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_sequences(packing.token_pieces(_table(spark, sf_dir, "documents")))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~held))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).select("doc_id", "license", "containment")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_jpeg.stored_texts(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))


def op12_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = quality_trees.held_out(F.col("doc_id"))
    model = quality_trees.fit(docs.where(~held), labels.where(~held))
    return quality_trees.score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_packing,
        op2_best_fit_packing,
        op3_embedding_near_dedup,
        op4_language_id,
        op5_license_scan,
        op6_order_minhash,
        op7_url_reputation,
        op8_progressive_jpeg,
        op9_warc,
        op10_source_mixing,
        op11_fill_middle,
        op12_quality_trees,
        op13_hard_negatives,
    )
}

#: Those that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op3_embedding_near_dedup": embedding_dedup.ORACLE,
    "op5_license_scan": license_scan.oracle(),
    "op7_url_reputation": url_reputation.ORACLE,
    "op9_warc": warc.ORACLE,
    "op10_source_mixing": mixing.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
