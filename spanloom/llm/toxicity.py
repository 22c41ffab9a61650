"""Counterfactual-regularised toxicity classifier.

A logistic model over which words a text holds. It is fitted on a bounded sample of labelled rows;
words of four or more of these whose share differs between toxic and other texts by at least ``z``
standard errors become features, and so does every identity term. Words are counted in Spark; the
driver gets each sampled row's features only. For each labelled text that names identity terms, one copy
has them swapped for others and one has them blanked; the squared changes of the score between text
and copies are part of the loss. So a group's name can't carry toxicity by itself, and neutral
mentions of groups aren't flagged.

Only the text is used, all of it. Defined results: null, empty and wordless texts score by the
intercept alone. Rows that repeat a labelled id count once in the fit; null labels don't count. With
no labels, or one kind only, the score is the share of toxic labels, drawn to one half by one row of
each kind. An empty table gives no rows. Extra columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import Scratch, columns_of

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000
#: Rows that hold a feature, at least.
LEAST = 4
Z, RIDGE, SWAP = 4.0, 1e-4, 1.0
#: Terms that name groups of people; each may stand for any other.
IDENTITIES = (
    "women", "men", "woman", "man", "girls", "boys", "muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu",
    "buddhist", "atheist", "black", "white", "asian", "latino", "african", "european", "american", "arab", "gay", "lesbian",
    "bisexual", "transgender", "straight", "immigrant", "immigrants", "refugee", "refugees", "disabled", "deaf", "blind", "old",
    "young", "elderly", "catholic", "protestant",
)


def word_keys(words: Sequence[str]) -> np.ndarray:
    """The hashes of single words."""
    return np.array([w[0] for w in (next(iter(textnum.words(pa.array([x]), gap=textnum.NOT_LETTER)))[2] for x in words)], np.uint64)


class Model:
    """Weights of words, by sorted hash, and an intercept."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], float(bias)

    def logits(self, column: pa.Array) -> np.ndarray:
        """Log odds of each whole text; a word counts once however often it stands there."""
        out = np.full(len(column), self.bias)
        if not len(self.keys):
            return out
        seen: list[np.ndarray] = []
        for lo, hi, w, counts in textnum.words(column, gap=textnum.NOT_LETTER):
            at = np.searchsorted(self.keys, w)
            known = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == w)
            seen.append(np.unique(np.repeat(np.arange(lo, hi), counts)[known] * len(self.keys) + at[known]))
        if seen:
            pairs = np.unique(np.concatenate(seen))
            out += np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)], len(column))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_words(rows: list[np.ndarray], y: np.ndarray, identities: Sequence[str] = IDENTITIES, swap: float = SWAP, z: float = Z, ridge: float = RIDGE, rounds: int = 400, seed: int = 5) -> Model:
    """The model for labelled rows, each given as the distinct hashes of its words."""
    toxic, clean = int(y.sum()), int(len(y) - y.sum())
    if not toxic or not clean:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.log((toxic + 1) / (clean + 1)))
    owner, flat = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    names, code = np.unique(flat, return_inverse=True)
    in_toxic = np.bincount(code[y[owner] == 1], minlength=len(names))
    in_all = np.bincount(code, minlength=len(names))
    share = in_all / len(y)
    gap = in_toxic / toxic - (in_all - in_toxic) / clean
    far = np.abs(gap) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / toxic + 1 / clean))
    terms = word_keys(identities)
    chosen = np.flatnonzero((far >= z) & (in_all >= LEAST) & ~np.isin(names, terms))
    keys = np.concatenate((names[chosen], terms))
    order = np.argsort(keys)
    keys = keys[order]
    at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
    on = keys[at] == flat
    row, col = owner[on], at[on]
    # the swapped copies: each identity term of a text is replaced by another one
    is_term = np.isin(keys, terms)
    place = np.flatnonzero(is_term)
    named = is_term[col]
    step = np.random.default_rng(seed).integers(1, max(2, len(place)), int(named.sum()))
    swapped = place[(np.searchsorted(place, col[named]) + step) % len(place)] if len(place) else col[named]
    texts, pair = np.unique(row[named], return_inverse=True)
    w, b = np.zeros(len(keys)), np.log(toxic / clean)
    mean, var = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for k in range(1, rounds + 1):
        p = sigmoid(b + np.bincount(row, w[col], len(rows)))
        error = (p - y) / len(y)
        slope = np.bincount(col, error[row], len(keys)) + 2 * ridge * w
        if len(texts):
            change = np.bincount(pair, w[col[named]] - w[swapped], len(texts)) * (2 * swap / len(texts))
            blanked = np.bincount(pair, w[col[named]], len(texts)) * (2 * swap / len(texts))
            slope += np.bincount(col[named], (change + blanked)[pair], len(keys)) - np.bincount(swapped, change[pair], len(keys))
        g = np.append(slope, error.sum())
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        moved = 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(var / (1 - 0.999**k)) + 1e-8)
        w, b = w - moved[:-1], b - moved[-1]
    return Model(keys, w, b)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, mark: str, sample: int, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id") -> DataFrame:
    """``text, y`` of at most ``sample`` labelled documents that aren't held out, the same ones each time."""
    marks = columns_of(labels, doc_id=label_id, y=mark).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    drawn = marks.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = columns_of(docs, doc_id=doc_id, text=text).join(F.broadcast(drawn), "doc_id")  # at most `sample` rows
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")


def telling_words(rows: DataFrame, z: float = Z) -> np.ndarray:
    """The hashes of the words whose share differs enough, from ``words array<long>, y``."""
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    if not toxic or not clean:
        return np.zeros(0, np.uint64)
    counts = rows.select(F.explode("words").alias("w"), "y").groupBy("w").agg(F.count("*").alias("n"), F.sum("y").alias("t")).where(F.col("n") >= LEAST)
    share = F.col("n") / (toxic + clean)
    far = F.abs(F.col("t") / toxic - (F.col("n") - F.col("t")) / clean) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / toxic + 1 / clean))
    return counts.where(far >= 0.999 * z).select("w").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "toxic", sample: int = SAMPLE, z: float = Z, identities: Sequence[str] = IDENTITIES, **options) -> Model:
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w, counts in textnum.whole_rows(textnum.words(batch.column(0), gap=textnum.NOT_LETTER)):
                each = [np.unique(x) for x in np.split(w, np.cumsum(counts)[:-1])]
                words = textnum.ragged(np.concatenate(each).view(np.int64), np.array([len(x) for x in each])).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([words, batch.column(1).slice(lo, hi - lo).cast(pa.int32())], names=["words", "y"])

    rows = labelled_sample(docs, labels, mark, sample, doc_id, text)
    rows = Scratch(docs.sparkSession, "labelled").keep(rows.mapInArrow(distinct, "words array<long>, y int"))
    known = np.concatenate((telling_words(rows, z), word_keys(identities)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = np.asarray(batch.column(0).flatten()).view(np.uint64), np.asarray(batch.column(0).value_lengths()).astype(np.int64)
            on, owner = np.isin(flat, known), np.repeat(np.arange(len(n)), n)
            yield pa.RecordBatch.from_arrays([textnum.binaries(flat[on], np.bincount(owner[on], minlength=len(n))), batch.column(1)], names=["words", "y"])

    got = rows.mapInArrow(features, "words binary, y int").toArrow()
    y = got.column("y").to_numpy().astype(np.int64)
    return fit_words([np.frombuffer(x.as_buffer(), np.uint64) for x in got.column("words")], y, identities, z=z, **options)


def score(text: Column, model: Model) -> Column:
    """Probability that a text is toxic."""

    def of(column: pa.Array) -> pa.Array:
        return pa.array(sigmoid(model.logits(column)))

    of.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, "double")(text)


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: float = 0.5, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document."""
    model = fit(docs, labels, doc_id, text, **options)
    rows = columns_of(docs, doc_id=doc_id, text=text).select("doc_id", score(F.col("text"), model).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= limit, 1).otherwise(0).alias("predicted"))
