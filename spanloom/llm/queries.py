"""The registered queries of this subpackage: thin callers of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import e8_dedup, line_dedup, multi_index, order_minhash, packing, piece_codec, quality, token_counts, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents"), eos=1))


def op2_e8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e8_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "component_id", "kept")


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    judged, _ = quality.with_quality(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "evidence", "site_rate", "score", "accepted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 9).alias("bad_rate"), F.round("bad_rate_low", 9).alias("bad_rate_low"))


def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_repeats(docs).select("doc_id", "n_lines", "n_removed", "text")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_histogram": op1_token_histogram,
    "op2_e8_near_duplicates": op2_e8_near_duplicates,
    "op3_order_minhash": op3_order_minhash,
    "op4_multi_index_hashing": op4_multi_index_hashing,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_url_reputation": op8_url_reputation,
    "op9_line_windows": op9_line_windows,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLES: dict[str, str] = {
    "op8_url_reputation": url_filter.SQL,
    "op9_line_windows": line_dedup.SQL,
}
