"""A corpus pipeline: languages, near duplicates, mixing, packing. Each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, mixing, order_minhash, packing
from tessera.llm.common import scratch_path, spare_names


#: Documents whose predicted language is less likely than this are rejected. Texts of a few sentences in one language score about 0.96.
LEAST_SCORE = 0.5


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is predicted with a score of LEAST_SCORE at least.

    Texts that are null or have no letter are `und` with score 0 and go; so do those that the machines decide no better than by chance, such as
    a few letters among figures and signs or texts half in one language and half in another. Without a usable label there is no model: then all documents with a letter stay. Repeated rows are
    alike; columns named like a prediction stay as they are; an empty table gives an empty one.
    """
    model = language_id.fit(docs)
    if model is None:
        return docs.where(r"text rlike '\\p{L}'")
    lang, score = spare_names(docs, "lang_pred", "score")
    known = language_id.identify(docs, model, lang_name=lang, score_name=score)
    return known.where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*(f"`{c}`" for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the least id; null ids and null texts stay. See kept_documents for ties."""
    return order_minhash.kept_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source has its share; null texts have no words and go. See mix for ties."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document (and copy) in sequences of 2048 tokens; a null text is an end id alone."""
    return packing.best_fit_sequences(packing.token_pieces(docs))


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: No stage is SQL: machines are trained, candidates hashed, tokens encoded.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; every result is written as Parquet in the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
