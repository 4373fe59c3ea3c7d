"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination and token ids, one stage after the other.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the last return the
columns of the documents. Written between stages, each stage's input is read again as a table of its own, which goes once
the next one is written.

Defined results, for every stage: an empty table gives no rows; repeated rows are judged each by itself and alike; columns
that are not named below are not read and stay, whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entwyne.llm import bpe, decontam, linedup, neardup, quality
from entwyne.llm.common import bounded_batches, discard, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go.

    A null or empty text fails the base rules. Reads doc_id, text and lang; a null or unknown lang is a stratum of its own.
    Without labels only the base rules act; labels with a null id or quality are ignored, of several the best counts.
    """
    bounded_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go, all of them; n_chars follows the text where lines went.

    Each row is a document of its own. A null text stays null; a text may become empty.
    """
    out = linedup.drop_frequent_lines(docs, min_docs=10, min_chars=1)
    length = F.when(F.col("__entwyne_lines.n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest doc_id stays.

    Rows that share a doc_id are judged by their own texts; equal rows with that doc_id all stay. Rows with a null doc_id
    and texts without a word are linked with nothing and stay.
    """
    return neardup.keep_one(docs, percent=80, shingle=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten words of a benchmark item, or a whole shorter item, go. Null texts have no words."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of what is left: number of ids, digests of the ids and of the decoded bytes. A null text is empty."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: SQL has no MinHash components, binomial cutoffs or byte-pair merges; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
