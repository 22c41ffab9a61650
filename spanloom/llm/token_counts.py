"""Exact length histogram: documents are aggregated by encoded length; suffix sums answer every limit.

One pass encodes whole texts and counts documents per length with map-side partial sums, so what is
shuffled is at most one row per length and task. Suffix sums are taken per block of lengths and over
block totals, so no task holds the whole histogram.

Defined results: a null text counts as empty, an empty text has ``eos`` tokens. Repeated rows count
each. An empty table has an empty histogram. Extra columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe
from .common import Scratch, columns_of

#: Lengths in a block of the suffix sums.
BLOCK = 4096


def token_count(text: Column, tokenizer: str | None = None) -> Column:
    """The number of ids of each whole text, as a column expression."""
    path = tokenizer or bpe.default_tokenizer()

    def count(column: pa.Array) -> pa.Array:
        return pa.array(bpe.encoder(path).lengths(column), pa.int64())

    count.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(count, "long")(text)


def length_histogram(df: DataFrame, text: str = "text", tokenizer: str | None = None, eos: int = 0) -> DataFrame:
    """``n_tokens, n_docs``: how many documents have each encoded length, ``eos`` tokens added to each."""
    rows = columns_of(df, text=text).select((token_count(F.col("text"), tokenizer) + F.lit(eos)).alias("n_tokens"))
    return rows.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``docs_ge, tokens_ge`` (documents of at least this length, and their tokens),
    ``total_docs, total_tokens``, ``truncated_total`` (tokens left when each document is cut to this
    length) and ``cum_share`` (share of documents of at most this length)."""
    histogram = Scratch(histogram.sparkSession, "lengths").keep(histogram)  # read twice below
    rows = histogram.withColumn("_block", F.floor(F.col("n_tokens") / F.lit(block)).cast("long"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    totals = rows.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum(tokens).alias("_t"))
    above = W.orderBy(F.col("_block").desc()).rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    totals = totals.select(
        "_block",
        F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_d_above"),
        F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_t_above"),
        F.sum("_d").over(every).alias("total_docs"),
        F.sum("_t").over(every).alias("total_tokens"),
    )
    inside = W.partitionBy("_block").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.join(totals, "_block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("_d_above")).alias("docs_ge"),
        (F.sum(tokens).over(inside) + F.col("_t_above")).alias("tokens_ge"),
        "total_docs",
        "total_tokens",
    )
    return out.withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).withColumn(
        "cum_share", (F.col("total_docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("total_docs")
    )


def truncated_totals(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For each context limit: ``docs_ge`` documents reach it, ``truncated_total`` tokens are left when all are cut to it."""
    asked = sums.select("*", F.explode(F.array(*[F.lit(int(x)) for x in limits])).alias("context_limit"))
    found = asked.groupBy("context_limit").agg(
        F.expr("min_by(struct(docs_ge, tokens_ge), n_tokens) filter (where n_tokens >= context_limit)").alias("at"),
        F.max("total_tokens").alias("total_tokens"),
    )
    docs, tokens = F.coalesce("at.docs_ge", F.lit(0)), F.coalesce("at.tokens_ge", F.lit(0))
    return found.select("context_limit", docs.alias("docs_ge"), (F.col("total_tokens") - tokens + docs * F.col("context_limit")).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``share, n_tokens``: the smallest length that at least this share of documents doesn't exceed."""
    asked = sums.select("n_tokens", "cum_share", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return asked.where(F.col("cum_share") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def brute_force(lengths: Sequence[int]) -> list[tuple[int, int, int, int, int]]:
    """``n_tokens, n_docs, docs_ge, tokens_ge, truncated_total`` from a plain list, for tests."""
    x = np.asarray(lengths, np.int64)
    return [(int(n), int((x == n).sum()), int((x >= n).sum()), int(x[x >= n].sum()), int(np.minimum(x, n).sum())) for n in np.unique(x)]
