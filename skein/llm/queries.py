"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skein.llm import (
    bpe, fingerprint, jaccard, licenses, lines, mixing, packing, periods, pii, prefixes, quality, substrings, suffixes,
)
from skein.llm.common import documents
from skein.llm.oracles import SQL

__all__ = ["QUERIES", "SQL"]

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op2_cdc_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op3_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find(documents(spark, sf_dir)))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return lines.summary(docs, lines.keep_bitmaps(docs))


def op5_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.summary(bpe.encode(documents(spark, sf_dir), path, decoded=True))


def op6_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.summary(jaccard.join(documents(spark, sf_dir)))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(documents(spark, sf_dir))
    return mix.select("doc_id", "source", "block", "slot", "position")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.summary(suffixes.dedup(documents(spark, sf_dir)))


def op10_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.summary(substrings.dedup(documents(spark, sf_dir)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.summary(*prefixes.trie(prefixes.conversations(spark, sf_dir), prefixes.planted))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.summary(periods.collapse(documents(spark, sf_dir), periods.planted))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_cdc_fingerprints": op2_cdc_fingerprints,
    "op3_pii_anchors": op3_pii_anchors,
    "op4_line_dedup": op4_line_dedup,
    "op5_bpe_trie": op5_bpe_trie,
    "op6_chosen_path_join": op6_chosen_path_join,
    "op7_quality_cascade": op7_quality_cascade,
    "op8_pfair_mix": op8_pfair_mix,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_cover_dedup": op10_cover_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_periodic_runs": op13_periodic_runs,
}
