"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import cotraining, exact_dedup, jaccard_join, mixing, packing
from millrace.llm.common import staged
from millrace.llm.queries import WEIGHTS, tokenizer_file


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; without labels, or with one class of them, all stay.

    Null and empty texts and null metadata are scored like any others, whole texts of any length are read, repeated rows
    go or stay together, other columns pass.
    """
    return cotraining.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; null texts count as empty, null ids rank lowest, and of rows that repeat an
    id and a text one stays."""
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents at a similarity of 0.75 or more, the one with the smallest id stays.

    Null and empty texts are like nothing, so they stay; null ids rank highest, and of rows that repeat an id and a text one
    stays (those without words all do)."""
    return jaccard_join.keep_first(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ``mix_position``: read by it, the sources come in their target weights.

    Null sources count as the empty string, repeated rows each get a place, and no rows give none; texts are not read.
    """
    return mixing.mix_sources(docs, WEIGHTS).select(*[c for c in docs.columns if c != "mix_position"], "mix_position")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its sequence and its place there; sequences follow the mix.

    A null text is its end mark only; documents longer than a sequence are cut; no rows give no pieces."""
    return packing.pack_in_order(docs, tokenizer_file(), "mix_position")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("mixing", source_mix),
    ("best_fit_packing", packed_sequences),
]

#: Model scores, shingle sets and token ids aren't SQL's; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
