"""Quality by hierarchical empirical Bayes: a document's own evidence, and its site's.

A small logistic model over the shares of kinds of characters and of repeated words gives each document's evidence as log
odds. Per path and per host, the documents' good shares are summed; a path's rate is drawn to its
host's and a host's to the global rate, the more the fewer documents it has; how much is estimated
from the spread between sites. A document's own share is taken out of its site's sums, then evidence
and site's log odds are added. Labels enter the document model alone: a site's sums are made of what
that model says about the site's other documents, labelled or not.

Documents without a path-like column can name any two nested columns (host, path); null is a site
of its own. Defined results: null and empty texts have the evidence of a text without characters.
Without labels, or with one kind only, the evidence is 0 and all documents are accepted or not by
the prior. Repeated rows are judged each; an empty table gives no rows. Extra columns are kept by
:func:`with_quality` and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum, toxicity
from .common import Scratch, columns_of, free_name
from .url_filter import pull

#: Labelled rows that the document model is fitted on, at most.
SAMPLE = 12_000
#: Sites (host and path) up to which their table is broadcast; beyond it, it is joined by a shuffle.
FEW_SITES = 50_000
#: Kinds of bytes: 0 letter, 1 capital, 2 digit, 3 blank, 4 line end, 5 exclamation, 6 bar, 7 symbol, 8 punctuation, 9 beyond ASCII, 10 control.
_KIND = np.full(256, 10, np.int64)
for _kind, _signs in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", "!", "|", "#$%&*@^~<>{}[]\\/_=+`", ".,;:'\"?()-")):
    _KIND[[ord(c) for c in _signs]] = _kind
_KIND[128:] = 9


def features(column: pa.Array) -> np.ndarray:
    """(rows, 11) shares of kinds of characters in each whole text, and of words equal to the word before."""
    data, offsets = textnum.buffers(column)
    n = np.zeros((len(offsets) - 1, 11))
    for a, b, lo, hi in textnum.segments(data, offsets):
        owner = np.repeat(np.arange(hi - lo) * 11, np.diff(np.clip(offsets[lo : hi + 1] - a, 0, b - a)))
        n[lo:hi] += np.bincount(owner + _KIND[data[a:b]], minlength=(hi - lo) * 11).reshape(-1, 11)
    again = np.zeros(len(offsets) - 1)
    for lo, hi, w, counts in textnum.words(column):
        owner = np.repeat(np.arange(lo, hi), counts)
        same = np.flatnonzero((w[1:] == w[:-1]) & (owner[1:] == owner[:-1]))
        again += np.bincount(owner[same], minlength=len(again))
    letters, total, words = n[:, 0] + n[:, 1] + n[:, 9], n.sum(1) + 1, n[:, 3] + n[:, 4] + 1
    return np.stack([
        n[:, 1] / (letters + 1), n[:, 2] / total, np.minimum(n[:, 5] / words, 2), np.minimum(n[:, 6] / words, 2), np.minimum(n[:, 7] / words, 4),
        np.minimum(n[:, 8] / words, 4), n[:, 10] / total, n[:, 4] / words, np.minimum(np.log1p(letters / words), 4), letters / total, again / words,
    ], axis=1)


class Model:
    """Logistic regression on standardised features, with the log odds of the sample taken out."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30):
        good = float(y.sum())
        self.prior = (good + 1) / (len(y) + 2)
        self.mean, self.sd = (x.mean(0), x.std(0) + 1e-6) if len(y) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.w = np.zeros(x.shape[1] + 1)
        if not 0 < good < len(y):
            return
        a = np.column_stack((self._scaled(x), np.ones(len(x))))
        for _ in range(rounds):  # Newton steps
            p = toxicity.sigmoid(a @ self.w)
            weight = np.maximum(p * (1 - p), 1e-6) / len(y)
            keep = ridge * np.append(np.ones(x.shape[1]), 0)
            step = np.linalg.solve((a * weight[:, None]).T @ a + np.diag(keep + 1e-9), a.T @ ((p - y) / len(y)) + keep * self.w)
            self.w -= step * min(1, 5 / (np.abs(step).max() + 1e-12))
        self.w[-1] -= np.log(self.prior / (1 - self.prior))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -6, 6)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """How much likelier a text is when good, as log odds; within 8 either way."""
        return np.clip(self._scaled(x) @ self.w[:-1] + self.w[-1], -8, 8)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "quality", sample: int = SAMPLE) -> Model:
    """The document model, from labelled rows that aren't held out."""

    def shares(batches):
        for batch in batches:
            x = features(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["x", "y"])

    got = toxicity.labelled_sample(docs, labels, mark, sample, doc_id, text).mapInArrow(shares, "x array<double>, y int").toArrow()
    x = np.array(got.column("x").to_pylist(), float) if got.num_rows else np.zeros((0, 11))
    return Model(x, got.column("y").to_numpy().astype(float))


def evidence(text: Column, model: Model) -> Column:
    def of(column: pa.Array) -> pa.Array:
        return pa.array(model.evidence(features(column)))

    of.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, "double")(text)


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def with_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", sample: int = SAMPLE, limit: float = 0.5) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns evidence, site_rate, score and accepted, and the names they got."""
    names = {c: free_name(docs, c) for c in ("evidence", "site_rate", "score", "accepted")}
    model = fit(docs, labels, doc_id, text, sample=sample)
    base = float(np.log(model.prior / (1 - model.prior)))

    def sited(df: DataFrame, *more: Column) -> DataFrame:
        place = [F.to_json(F.array(F.col(f"`{host}`").cast("string"))).alias("h"), F.to_json(F.array(F.col(f"`{path}`").cast("string"))).alias("p")]
        return df.select(*more, *place, evidence(F.col(f"`{text}`"), model).alias("e"))

    share = 1 / (1 + F.exp(-(F.col("e") + base)))
    paths = sited(docs).select("h", "p", share.alias("y")).groupBy("h", "p").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    paths = Scratch(docs.sparkSession, "sites").keep(paths)
    hosts = paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.count("*").alias("k")).first()
    rate = ((total["y"] or 0) + 1) / ((total["n"] or 0) + 2)
    of_host, of_path = pull(hosts), pull(paths)
    sites = paths.join(hosts.select("h", F.col("n").alias("hn"), F.col("y").alias("hy")), "h")
    if paths.count() <= FEW_SITES:
        sites = F.broadcast(sites)  # counted just now
    rows = sited(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(sites, ["h", "p"])
    own = share
    of_h = (F.greatest(F.col("hy") - own, F.lit(0.0)) + of_host * rate) / (F.col("hn") - 1 + of_host)
    of_p = (F.greatest(F.col("y") - own, F.lit(0.0)) + of_path * F.col("of_h")) / (F.col("n") - 1 + of_path)
    rows = rows.withColumn("of_h", of_h).withColumn("of_p", F.least(F.greatest(of_p, F.lit(1e-6)), F.lit(1 - 1e-6)))
    rows = rows.withColumn("s", 1 / (1 + F.exp(-(F.col("e") + _odds(F.col("of_p"))))))
    made = [F.col("e").alias(names["evidence"]), F.col("of_p").alias(names["site_rate"]), F.col("s").alias(names["score"]), F.when(F.col("s") >= limit, 1).otherwise(0).alias(names["accepted"])]
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *made), names
