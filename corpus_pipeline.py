"""A training corpus from `documents`: five stages, each written as Parquet and read by the next.

All stages take rows with null or repeated ids, null, empty and very long texts, and further columns; an empty table
goes through all of them and gives no rows.  Reruns give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.common import discard, small_batches, stored
from stopwise.llm.exact import dedup_exact
from stopwise.llm.langid import held_out, identify, train
from stopwise.llm.minhash import dedup_near
from stopwise.llm.mixing import mixed_documents
from stopwise.llm.packing import pack
from stopwise.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; `und` (a null text, or one without a letter) goes. Repeated rows stay. Where no document
    has a known language to learn from, all with a letter stay."""
    small_batches(spark)
    model = train(docs.filter(~held_out()))
    found = identify(docs, model, into=("_lang_pred", "_lang_score"))
    rejected = F.col("_lang_pred") == "und" if model.langs else ~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return found.filter(~rejected).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts but for white space: the longest, then the smallest id, null ids last.
    A null text is an empty one, so one of all null and empty texts stays."""
    return dedup_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, that with the smallest id, null ids last: five-word shingles,
    similarity 0.8 or more. Texts without words are no near copies of anything and stay."""
    return dedup_near(docs, size=5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportion of their weights: documents repeated, kept, cut or left out. Documents without words, of
    which nothing can be taken, go; a null source is a source. n_chars is counted anew."""
    return mixed_documents(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixture's documents in sequences of 1024 tokens; a null text is the end id alone."""
    small_batches(spark)
    return pack(docs, tokenizer_path())


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("packed", packed)]

#: Language identification and packing cannot be expressed in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, former = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if former is not None:
            discard(former)
        former = docs
    return docs
