"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. Stages but the last return the
columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, jaccard, lines, mixing, quality
from skein.llm.common import documents, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents have stay in the one with the largest id; n_chars follows the text."""
    left = lines.drop_lines(docs, lines.keep_bitmaps(docs))
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one with the smallest id stays."""
    return jaccard.one_per_class(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, ordered so that any stretch holds the sources at their target shares."""
    return mixing.mixed(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with its place in the mix and digests of the ids and of the decoded text.

    A table of several files loses its row order when it is read, so ``slot`` and ``position`` tell the order.
    """
    path, place = public_tokenizers.path("byte_bpe_50k.json"), ["slot", "position"]
    encoded = bpe.encode(mixing.placed(docs), path, carried=place, decoded=True)
    return bpe.summary(encoded, *place, "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", source_mix),
    ("BPE encoding", bpe_tokens),
]

ORACLE_SQL = None  # not expressible in SQL; tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
