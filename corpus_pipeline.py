"""From raw documents to packed training sequences, each stage on what the one before kept.

1. quality: documents that the co-trained classifier rejects go.
2. exact: of equal texts (A-Z lower-cased) the row with the largest identifier stays; of rows that share this too, one.
3. near: of near duplicates (five-word shingles, similarity 0.8 or more) the row with the smallest identifier stays; rows
   that share an identifier are told apart by their texts.
4. mix: sources are brought to their target weights; a document appears as often as the mix takes it, so a row may be
   repeated, and documents that the mix leaves out go. The document at which a source's words run out is rounded.
5. pack: the pieces of all documents in sequences of 1024 tokens.

Stages take extra columns along. An empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import contentsort, mixing, neardup, packing, quality, tokens
from frameloom.llm.common import saved
from frameloom.session import workers_import_this


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, workers_import_this(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contentsort.without_copies(docs, keep="max")


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_import_this(spark)
    return neardup.without_near_copies(docs, similarity=80, width=5)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs, weights=(3, 1, 2), share=1.5, most=2)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_import_this(spark)
    return packing.packed(docs, tokens.default_vocabulary("byte_bpe_50k.json"), capacity=1024, end=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("exact", no_exact_copies),
    ("near", no_near_copies),
    ("mix", mixed_sources),
    ("pack", packed_sequences),
]

#: A trained classifier and a tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
