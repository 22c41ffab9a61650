"""Windows over tokens, votes between overlapping windows, tags to spans, and linear chains."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def token_windows(tokens: Column, size: int, stride: int) -> Column:
    """``array<struct<start, tokens>>``: windows of ``size`` tokens, each beginning ``size - stride`` further on."""
    step = max(1, size - stride)
    last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - size) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), F.slice(tokens, i * step + 1, size).alias("tokens")))


def overlap_vote(votes: DataFrame, key: list[str]) -> DataFrame:
    """``key, best, confidence, margin`` from ``key, cls, logit``: mean logits over windows, then softmax; class 0 is outside."""
    mean = votes.groupBy(*key, "cls").agg(F.avg("logit").alias("m"))
    total = F.sum(F.exp("m")).over(W.partitionBy(*key))
    p = mean.withColumn("p", F.exp("m") / total)
    outside = F.max(F.when(F.col("cls") == 0, F.col("p")))
    best = p.groupBy(*key).agg(F.max_by("cls", F.struct(F.round("p", 12), -F.col("cls"))).alias("best"), F.max("p").alias("confidence"), outside.alias("o"))
    return best.select(*key, "best", F.round("confidence", 6).alias("confidence"), F.round(F.col("confidence") - F.coalesce("o", F.lit(0.0)), 6).alias("margin"))


def tags_to_spans(tags: DataFrame, breaks: Column | None = None) -> DataFrame:
    """``doc_id, label, first, last, n`` from ``doc_id, pos, tag`` (O, B-x, I-x), runs of one label.

    A span begins at B, at an I that doesn't go on with its label, and where ``breaks`` holds.
    """
    w = W.partitionBy("doc_id").orderBy("pos")
    label = F.when(F.col("tag") == "O", None).otherwise(F.substring("tag", 3, 100))
    rows = tags.withColumn("label", label)
    before, at = F.lag("label").over(w), F.lag("pos").over(w)
    goes_on = F.col("tag").startswith("I-") & F.coalesce(before == F.col("label"), F.lit(False)) & (at == F.col("pos") - 1)
    if breaks is not None:
        goes_on = goes_on & ~breaks
    rows = rows.withColumn("island", F.sum(F.when(goes_on, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.where("label is not null").groupBy("doc_id", "island").agg(F.min("label").alias("label"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n")).drop("island")


def first_per_word(tokens: DataFrame) -> DataFrame:
    """The first token of each word of ``doc_id, word, pos, ...``."""
    rest = [c for c in tokens.columns if c not in ("doc_id", "word")]
    return tokens.groupBy("doc_id", "word").agg(F.min(F.struct("pos", *[c for c in rest if c != "pos"])).alias("x")).select("doc_id", "word", "x.*")


def viterbi(emissions: np.ndarray, moves: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[int]:
    """The best path of a linear chain."""
    best, back = start + emissions[0], []
    for e in emissions[1:]:
        total = best[:, None] + moves
        back.append(total.argmax(0))
        best = total.max(0) + e
    path = [int((best + end).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def log_partition(emissions: np.ndarray, moves: np.ndarray, start: np.ndarray, end: np.ndarray) -> float:
    """The log of the sum over all paths."""
    alpha = start + emissions[0]
    for e in emissions[1:]:
        total = alpha[:, None] + moves
        top = total.max(0)
        alpha = np.log(np.exp(total - top).sum(0)) + top + e
    total = alpha + end
    return float(np.log(np.exp(total - total.max()).sum()) + total.max())


def decode_chain(rows: DataFrame, moves: list[list[float]], start: list[float], end: list[float]) -> DataFrame:
    """``doc_id, path, log_share`` of rows ``doc_id, emissions array<array<double>>``."""
    m, s, t = np.array(moves), np.array(start), np.array(end)

    def run(batches):
        for b in batches:
            out = []
            for d, e in zip(b["doc_id"], b["emissions"], strict=True):
                x = np.stack([np.asarray(v, float) for v in e])
                p = viterbi(x, m, s, t)
                score = s[p[0]] + x[np.arange(len(p)), p].sum() + m[p[:-1], p[1:]].sum() + t[p[-1]]
                out.append((d, p, float(score - log_partition(x, m, s, t))))
            yield pd.DataFrame(out, columns=["doc_id", "path", "log_share"])

    return rows.select("doc_id", "emissions").mapInPandas(run, "doc_id long, path array<int>, log_share double")
