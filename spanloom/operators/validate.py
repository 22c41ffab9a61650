"""Checks of spans and of packages of documents, and the rows that sinks write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The span types, the flags, and which types may have flags or candidates.
TYPES = ("TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM", "CHẨN_ĐOÁN", "THUỐC")
FLAGS = ("isNegated", "isFamily", "isHistorical")
FLAGGED, LINKED = ("TRIỆU_CHỨNG", "CHẨN_ĐOÁN", "THUỐC"), ("CHẨN_ĐOÁN", "THUỐC")


def violations(raw: Column, text: Column, start: Column, end: Column, kind: Column, flags: Column, candidates: Column) -> Column:
    """``array<string>`` of the rules that a span breaks; empty for a sound one."""
    bounds = (start >= 0) & (start < end) & (end <= F.length(raw))
    rules = (
        ("invalid_position", ~bounds),
        ("text_mismatch", bounds & (F.substring(raw, start + 1, end - start) != text)),
        ("invalid_type", ~kind.isin(*TYPES)),
        ("invalid_assertions", F.size(F.array_except(flags, F.array(*[F.lit(x) for x in FLAGS]))) > 0),
        ("assertions_not_allowed", (F.size(flags) > 0) & ~kind.isin(*FLAGGED)),
        ("candidates_not_allowed", (F.size(candidates) > 0) & ~kind.isin(*LINKED)),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), name) for name, broken in rules]))


def strict(spans: DataFrame, broken: Column) -> DataFrame:
    """Fails at the first span that breaks a rule."""
    return spans.where(F.when(F.size(broken) > 0, F.raise_error(F.array_join(broken, ","))).otherwise(F.lit(True)))


def violation_counts(spans: DataFrame, rules: dict[str, str], key: list[str]) -> DataFrame:
    """``code, n`` for each rule (SQL that holds where it is broken), and ``duplicate_exact``.

    Duplicates are counted by groups, so a key that repeats very often is one row per task.
    """
    sums = spans.agg(*[F.coalesce(F.sum(F.expr(f"cast({sql} as int)")), F.lit(0)).alias(name) for name, sql in rules.items()])
    broken = sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("code"), F.col(n).cast("long").alias("n")) for n in rules])).alias("x")).select("x.*")
    doubles = spans.groupBy(*key).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)), F.lit(0)).cast("long").alias("n"))
    return broken.unionByName(doubles.select(F.lit("duplicate_exact").alias("code"), "n"))


def above_threshold(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """Spans whose measure (``metrics`` map) named for their type reaches its threshold; other types stay."""
    joined = spans.join(rules, "type", "left")  # broadcast by its size, if that is small
    return joined.where(F.col("threshold").isNull() | (F.element_at("metrics", F.col("metric")) >= F.col("threshold"))).select(*spans.columns)


def first_errors(spans: DataFrame, broken: Column, order: list[str], n: int = 20) -> DataFrame:
    """The first ``n`` rows that break a rule, with the rules (a report)."""
    return spans.withColumn("errors", broken).where(F.size("errors") > 0).orderBy(*order).limit(n)


def json_rows(spans: DataFrame) -> DataFrame:
    """``doc_id, n, json``: each document's spans as one JSON array in the order of ``ord``."""
    item = F.struct("text", F.array("start", "end").alias("position"), "type")
    lists = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))).alias("l"))
    return lists.select("doc_id", F.size("l").alias("n"), F.to_json(F.transform("l", lambda x: x.item)).alias("json"))


def completeness(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """``key, problem``: keys that are missing or unexpected."""
    missing = expected.select(key).join(given, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return missing.unionByName(given.select(key).distinct().join(expected, key, "left_anti").select(key, F.lit("unexpected").alias("problem")))
