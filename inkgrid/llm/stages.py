"""The stages of the corpus pipeline, each one operator with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import Store, prepare
from .exact_dedup import representatives
from .lang_id import accepted
from .mixing import mixed
from .near_dedup import similar_documents
from .packing import packed


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those without a letter go."""
    prepare(spark)
    return accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts (A-Z lowered), the smallest doc_id."""
    prepare(spark)
    return representatives(docs, keep="smallest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    return similar_documents(docs, Store(prepare(spark), "near"), k=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, documents of smaller sources again: as even as it gets with twice at most."""
    return mixed(docs, Store(prepare(spark), "mix"), entropy_share=1.0, most_passes=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece of a document."""
    import public_tokenizers

    return packed(docs, Store(prepare(spark), "pack"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)
