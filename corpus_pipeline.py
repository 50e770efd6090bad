"""A corpus pipeline: each stage's result is written as Parquet and read again as the documents of the next.

In every stage a null text counts as empty, ids may repeat or be null, other columns pass through under any names, and an
empty table gives an empty one. Texts without a letter, null and empty ones among them, end at the first stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivelake.llm import exact_dedup, jaccard, langid, mixing, packing
from drivelake.llm.common import stored, unused
from drivelake.llm.queries import tokenizer_path


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID doesn't reject; the model is learned from the rows with a language."""
    return langid.recognised(docs, langid.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, one row of that with the least id."""
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least id. Rows that share an id stay together."""
    (own,) = unused(docs, "kept_id")
    kept = jaccard.jaccard_groups(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own))
    return docs.join(kept.distinct(), docs["doc_id"].eqNullSafe(F.col(own)), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; at a source's cut, a document's first words."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, placed in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Language ID and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
