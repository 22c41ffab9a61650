"""The catalogue of registered queries, collected from the modules beside this one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    from . import eval_queries, generator_queries, link_queries, span_queries, text_queries

    return [text_queries, span_queries, link_queries, eval_queries, generator_queries]


def queries() -> dict[str, Query]:
    return {name: q for m in _modules() for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase spans of all documents, resolved and checked, counted by language and phrase."""
    from pyspark.sql import functions as F

    from spanloom.operators import intervals, occurrences
    from spanloom.plans.tables import table
    from spanloom.plans.text_queries import PHRASES

    docs = table(spark, sf_dir, "documents")
    found = occurrences.phrase_occurrences(docs, PHRASES).select("doc_id", "start", "end", F.col("phrase").alias("type"), F.col("start").alias("ord"), F.array().cast("array<string>").alias("assertions"), F.array().cast("array<string>").alias("candidates"))
    kept = intervals.same_span_priority(intervals.drop_nested(intervals.dedup_exact(found)), list(PHRASES))
    return kept.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "type").agg(F.count("*").alias("n"))
