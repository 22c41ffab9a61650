"""The training-data pipeline over ``documents``: quality, toxicity, line dedup, near-dedup, packing.

Every stage but the last returns the columns that it was given, whatever their names, types and order
(``doc_id``, ``text``, ``source`` and ``lang`` are read; ``n_chars`` follows the text where it is there).

Defined results: a null or empty text is judged by the classifiers as a text without characters, passes
line dedup as it is, is a near copy of all other texts without words, and packs as its end id alone.
Null ids and ids of any orderable type are kept; rows that repeat id and text are one document to
near-dedup. An empty table passes all stages and packs into nothing. Ties go to the smaller id. Without
any label the toxicity score is one half, which counts as toxic, so no document passes that stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import line_dedup, order_minhash, packing, quality, toxicity
from spanloom.llm.common import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (op6) accepts."""
    judged, names = quality.with_quality(docs, _labels(spark, sf_dir))
    return judged.where(F.col(names["accepted"]) == 1).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier (op5) doesn't flag."""
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return docs.where(toxicity.score(F.col("text"), model) < 0.5)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows (op9); ``n_chars`` follows the text."""
    left = line_dedup.without_repeats(docs).select(*docs.columns)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (op3)."""
    return order_minhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All kept documents as sequences of at most 2048 tokens (op7)."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("line dedup", without_repeated_lines),
    ("MinHash near-dedup", one_of_each_group),
    ("best-fit packing", pack),
]

#: The classifiers, the alignment and the tokenizer can't be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(docs)
    return docs
