"""Evaluation: precision and recall on keys, set agreement, thresholds, weights and gates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def safe(a: Column, b: Column) -> Column:
    """``a / b``, 0 where nothing is there to divide by."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def prf(predicted: DataFrame, reference: DataFrame, key: list[str], by: str) -> DataFrame:
    """``by, tp, pred, ref, precision, recall, f1`` on distinct keys; the row with null ``by`` is over all."""
    p, r = predicted.select(*key).distinct().withColumn("p", F.lit(1)), reference.select(*key).distinct().withColumn("r", F.lit(1))
    both = p.join(r, key, "full").select(F.col(by).alias("by"), F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("r", F.lit(0)).alias("r"))
    counts = both.rollup("by").agg(F.sum(F.col("p") * F.col("r")).alias("tp"), F.sum("p").alias("pred"), F.sum("r").alias("ref"))
    return counts.select("by", "tp", "pred", "ref", safe(F.col("tp"), F.col("pred")).alias("precision"), safe(F.col("tp"), F.col("ref")).alias("recall"), safe(2 * F.col("tp"), F.col("pred") + F.col("ref")).alias("f1"))


def best_thresholds(scored: DataFrame, by: str) -> DataFrame:
    """``by, threshold, f1``: the score from which on rows are best taken as positive (``score, y``).

    Running counts over falling scores give every threshold's F1 at once; ties go to the higher
    precision, then the lower threshold.
    """
    w = W.partitionBy(by).orderBy(F.desc("score"))
    per = scored.groupBy(by, "score").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    tp, n = F.sum("pos").over(w), F.sum("n").over(w)
    total = F.sum("pos").over(W.partitionBy(by))
    at = per.select(by, "score", tp.alias("tp"), n.alias("n"), total.alias("total"))
    f1 = F.round(safe(2.0 * F.col("tp"), F.col("n") + F.col("total")), 9)
    best = F.max_by(F.struct("score", f1.alias("f1")), F.struct(f1, F.round(F.col("tp") / F.col("n"), 9), -F.col("score")))
    return at.groupBy(by).agg(best.alias("b")).select(by, F.col("b.score").alias("threshold"), "b.f1")


def best_metrics(scored: DataFrame, by: str, metrics: Sequence[str]) -> DataFrame:
    """``by, metric, threshold, f1``: the measure, and its threshold, that tells positives (``y``) best; ties go to the first name."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in metrics])).alias("x")
    rows = scored.select(by, "y", each).select(F.struct(by, "x.metric").alias("_k"), "x.score", "y")
    best = best_thresholds(rows, "_k").select(F.col(f"_k.{by}").alias(by), F.col("_k.metric").alias("metric"), "threshold", "f1")
    first = F.row_number().over(W.partitionBy(by).orderBy(F.desc("f1"), "metric"))
    return best.withColumn("_r", first).where("_r = 1").drop("_r")


def grid(rows: DataFrame, measures: list[str], steps: list[float], truth: str) -> DataFrame:
    """``<measure>_at..., accuracy``: agreement for every combination of thresholds.

    Rows are counted by which steps they reach first, so the grid meets a few counts, not the rows.
    """
    def steps_reached(m: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s <= F.col(m))).alias(f"r_{m}")

    reached = [steps_reached(m) for m in measures]
    counts = rows.select(*reached, truth).groupBy(*[f"r_{m}" for m in measures], truth).agg(F.count("*").alias("n"))
    for m in measures:
        counts = counts.withColumn(f"{m}_at", F.explode(F.sequence(F.lit(1), F.lit(len(steps)))))
    hit = F.lit(True)
    for m in measures:
        hit = hit & (F.col(f"r_{m}") >= F.col(f"{m}_at"))
    good = F.when(hit == F.col(truth), F.col("n")).otherwise(0)
    out = counts.groupBy(*[f"{m}_at" for m in measures]).agg((F.sum(good) / F.sum("n")).alias("accuracy"))
    return out.select(*[F.element_at(F.array(*[F.lit(s) for s in steps]), F.col(f"{m}_at")).alias(f"{m}_at") for m in measures], "accuracy")


def class_weights(rows: DataFrame, by: str, y: str, most: float = 15.0) -> DataFrame:
    """``by, weight``: negatives per positive, at most ``most``."""
    return rows.groupBy(by).agg(F.least(F.sum(1 - F.col(y)) / F.greatest(F.sum(y), F.lit(1)), F.lit(most)).alias("weight"))


def candidate_fit(matched: DataFrame) -> DataFrame:
    """Agreement of code sets ``a`` and ``b`` over matched spans: exact, both empty, mean Jaccard, micro P and R."""
    both, union = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    j = F.when(union == 0, 1.0).otherwise(both / union)
    sums = matched.agg(
        F.count("*").alias("n"), F.sum(F.when(F.array_sort(F.array_distinct("a")) == F.array_sort(F.array_distinct("b")), 1).otherwise(0)).alias("exact"), F.sum(F.when(union == 0, 1).otherwise(0)).alias("both_empty"),
        F.avg(j).alias("jaccard"), F.sum(both).alias("tp"), F.sum(F.size(F.array_distinct("a"))).alias("pred"), F.sum(F.size(F.array_distinct("b"))).alias("ref"),
    )
    return sums.select("n", "exact", "both_empty", "jaccard", safe(F.col("tp"), F.col("pred")).alias("precision"), safe(F.col("tp"), F.col("ref")).alias("recall"))


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """One-to-one matches of ``doc_id, gold, pred, overlap``: the largest overlap first, ties by gold and pred."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["overlap", "gold", "pred"], ascending=[False, True, True])
        used_g, used_p, keep = set(), set(), []
        for g, p in zip(rows["gold"], rows["pred"], strict=True):
            ok = g not in used_g and p not in used_p
            keep.append(ok)
            if ok:
                used_g.add(g)
                used_p.add(p)
        return rows[np.array(keep, bool)]

    return pairs.groupBy("doc_id").applyInPandas(fold, pairs.schema)


def overlap_scores(matches: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """``tp, pred, ref, precision, recall, f1, jaccard`` of one-to-one matches; the Jaccard is F1 / (2 - F1)."""
    counts = matches.agg(F.count("*").alias("tp")).crossJoin(predicted.agg(F.count("*").alias("pred"))).crossJoin(gold.agg(F.count("*").alias("ref")))  # three single rows
    f1 = safe(2.0 * F.col("tp"), F.col("pred") + F.col("ref"))
    return counts.select("tp", "pred", "ref", safe(F.col("tp"), F.col("pred")).alias("precision"), safe(F.col("tp"), F.col("ref")).alias("recall"), f1.alias("f1"), (f1 / (2 - f1)).alias("jaccard"))


# The parts of the weighted score.
TEXT_PART, FLAG_PART, CODE_PART = 0.3, 0.3, 0.4


def weighted_score(items: DataFrame) -> DataFrame:
    """``text_score, flag_score, code_score, score`` of rows ``wer, flags, gold_flags, codes, gold_codes, n_gold, wrong_type``.

    Texts count 1 - error rate, flags and codes their Jaccard (1 where both are empty); codes are
    weighted by the number of gold codes and one. An item of the wrong type counts twice, with 0 each time.
    """
    zero = F.col("wrong_type")
    both = lambda a, b: F.when(F.size(F.array_union(a, b)) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    times, weight = F.when(zero, 2).otherwise(1), F.size("gold_codes") + 1
    part = lambda x: F.when(zero, 0.0).otherwise(x)
    sums = items.agg(
        F.sum(times).alias("n"), F.sum(part(1 - F.col("wer"))).alias("text"), F.sum(part(both("flags", "gold_flags"))).alias("flags"),
        F.sum(part(both("codes", "gold_codes") * weight)).alias("codes"), F.sum(times * weight).alias("weights"),
    )
    out = sums.select(safe(F.col("text"), F.col("n")).alias("text_score"), safe(F.col("flags"), F.col("n")).alias("flag_score"), safe(F.col("codes"), F.col("weights")).alias("code_score"))
    return out.withColumn("score", TEXT_PART * F.col("text_score") + FLAG_PART * F.col("flag_score") + CODE_PART * F.col("code_score"))


def boundary_ceiling(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """``total, representable``: how many spans begin and end where some token (doc_id, start, end; not empty) does."""
    some = tokens.where("start < end")
    starts, ends = some.select("doc_id", "start").distinct().withColumn("s", F.lit(1)), some.select("doc_id", "end").distinct().withColumn("e", F.lit(1))
    both = spans.select("doc_id", "start", "end").join(starts, ["doc_id", "start"], "left").join(ends, ["doc_id", "end"], "left")
    return both.agg(F.count("*").alias("total"), F.count_if(F.col("s").isNotNull() & F.col("e").isNotNull()).alias("representable"))


def agreement(rows: DataFrame, by: str, predicted: str, truth: str) -> DataFrame:
    """``bucket, n, accuracy`` by bucket and over all (bucket "all")."""
    same = F.avg((F.col(predicted) == F.col(truth)).cast("int"))
    return rows.rollup(F.col(by).alias("_b")).agg(F.count("*").alias("n"), same.alias("accuracy")).select(F.coalesce("_b", F.lit("all")).alias("bucket"), "n", "accuracy")


def flag_fit(matched: DataFrame) -> DataFrame:
    """``n, exact, jaccard`` of flag sets ``a`` and ``b`` over matched spans that may have flags."""
    union = F.size(F.array_union("a", "b"))
    j = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / union)
    return matched.agg(F.count("*").alias("n"), F.avg((F.array_sort(F.array_distinct("a")) == F.array_sort(F.array_distinct("b"))).cast("int")).alias("exact"), F.avg(j).alias("jaccard"))


def strategies(rows: DataFrame, ways: dict[str, Column]) -> DataFrame:
    """``strategy, n, hits, accuracy`` of conditions that say where each strategy is right."""
    each = F.array(*[F.struct(F.lit(n).alias("strategy"), ok.cast("int").alias("ok")) for n, ok in ways.items()])
    return rows.select(F.inline(each)).groupBy("strategy").agg(F.count("*").alias("n"), F.sum("ok").alias("hits"), F.avg("ok").alias("accuracy"))


def contingency(rows: DataFrame, tier: str, band: Column, bands: Sequence[str]) -> DataFrame:
    """``tier`` and one count per band."""
    return rows.groupBy(F.col(tier).alias("tier")).agg(*[F.count_if(band == b).alias(b) for b in bands])


def examples(rows: DataFrame, tier: str, key: str, n: int) -> DataFrame:
    """The first ``n`` rows of each tier by key (a report)."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(tier).orderBy(key))).where(F.col("place") <= n)


def votes(rows: DataFrame, by: str, yes: Column, quorum: int) -> DataFrame:
    """``by, votes, accepted``: how many rows say yes, and whether they are a quorum."""
    return rows.groupBy(by).agg(F.count_if(yes).alias("votes")).withColumn("accepted", F.col("votes") >= quorum)


def lexicon(spans: DataFrame, shortest: int = 2) -> DataFrame:
    """``type, phrase, n``: how often each text of ``shortest`` or more characters has a type."""
    return spans.where(F.length("text") >= shortest).groupBy("type", F.col("text").alias("phrase")).agg(F.count("*").alias("n"))


def confidence(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """``key, mean, least, margin, n`` of scores."""
    return rows.groupBy(*key).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), (F.max(value) - F.min(value)).alias("margin"), F.count("*").alias("n"))


def counters(rows: DataFrame, by: Sequence[str], size: str) -> DataFrame:
    """``by, n, chars``: rows and their summed size."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(size).alias("chars"))


def feature_rates(rows: DataFrame, by: str, features: dict[str, Column]) -> DataFrame:
    """``by, n`` and the share of rows that each condition holds for."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(c.cast("int")).alias(n) for n, c in features.items()])


def pool_recall(pools: DataFrame, gold: DataFrame) -> DataFrame:
    """``n, found, recall``: for how many queries (qid, gold) the pool (qid, code) holds the gold code."""
    hit = gold.join(pools.select("qid", F.col("code").alias("gold")).distinct().withColumn("hit", F.lit(1)), ["qid", "gold"], "left")
    return hit.agg(F.count("*").alias("n"), F.count("hit").alias("found")).withColumn("recall", safe(F.col("found"), F.col("n")))


def word_error_rate(left: Column, right: Column) -> Column:
    """Word edits over the words of ``right``, at most 1; 0 where both have none."""

    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
            x, y = x.split(), y.split()
            row = np.arange(len(y) + 1)
            for i, w in enumerate(x, 1):
                cost = np.minimum(row[1:] + 1, row[:-1] + (np.array(y, object) != w)) if y else np.zeros(0, int)
                steps = np.arange(1, len(y) + 1)
                row = np.concatenate(([i], np.minimum.accumulate(np.minimum(cost, i + steps) - steps) + steps)).astype(int)
            out.append(0.0 if not x and not y else min(1.0, row[-1] / max(len(y), 1)))
        return pd.Series(out)

    of.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(of, "double")(left, right)


def note_gate(docs: DataFrame, spans: DataFrame, low: float, high: float, shortest: int = 200) -> DataFrame:
    """``doc_id, density, errors``: what keeps a note out, from its text and its number of spans."""
    n = spans.groupBy("doc_id").agg(F.count("*").alias("n"))
    j = docs.select("doc_id", F.length("text").alias("chars")).join(n, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    density = F.round(safe(1000.0 * F.col("n"), F.col("chars")), 6)
    errors = F.array_compact(F.array(F.when(F.col("chars") < shortest, "short"), F.when(F.col("n") == 0, "empty"), F.when(~density.between(low, high), "density")))
    return j.select("doc_id", density.alias("density"), F.array_join(errors, ",").alias("errors"))


def batch_gate(rates: DataFrame, targets: DataFrame, n: Column) -> DataFrame:
    """``name, rate, target, ok``: rates within 0.10 or two binomial deviations of their targets."""
    room = F.greatest(F.lit(0.10), 2 * F.sqrt(F.col("target") * (1 - F.col("target")) / n))
    return rates.join(targets, "name").select("name", "rate", "target", (F.abs(F.col("rate") - F.col("target")) <= room).alias("ok"))
