"""Plug-ins in place of trained models: protocols, and adapters that run them over Arrow batches."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SpanGenerator(Protocol):
    def predict(self, text: str) -> Sequence[tuple[int, int, str]]: ...


class Embedder(Protocol):
    def encode(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class PairScorer(Protocol):
    def score(self, query: str, candidates: Sequence[str]) -> Sequence[float]: ...


def generate_spans(docs: DataFrame, make: Callable[[], SpanGenerator]) -> DataFrame:
    """``doc_id, start, end, type, text``: predictions whose places lie in the text; ``make`` runs once per worker task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            rows = [(d, s, e, k, x[s:e]) for d, x in zip(b["doc_id"], b["text"], strict=True) if x for s, e, k in model.predict(x) if 0 <= s < e <= len(x)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "type", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, start int, end int, type string, text string").distinct()


def generate_texts(segments: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """``segments`` with ``response``: a batch of prompts, shortest first, goes to the generator at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            order = b["prompt"].str.len().sort_values(kind="stable").index
            said = model(b.loc[order, "prompt"].tolist())
            if len(said) != len(b):
                raise ValueError("the generator must answer every prompt")
            yield b.assign(response=pd.Series(said, index=order))

    return segments.mapInPandas(run, segments.schema.simpleString()[7:-1] + ",response:string")


def embed(text: Column, make: Callable[[], Embedder]) -> Column:
    """Vectors of texts; each different text of a batch is encoded once."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for b in batches:
            one = list(dict.fromkeys(b.fillna("")))
            known = dict(zip(one, model.encode(one), strict=True))
            yield b.fillna("").map(known)

    of.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(of, "array<float>")(text)


def pair_scores(query: Column, name: Column, make: Callable[[], PairScorer]) -> Column:
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, n in batches:
            yield pd.Series([float(model.score(a, [b])[0]) for a, b in zip(q, n, strict=True)])

    of.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(of, "double")(query, name)


def token_f1(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    return 2 * len(x & y) / (len(x) + len(y)) if x & y else 0.0


def _ratio(a: str, b: str) -> float:
    return 100 * difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def fuzzy(a: str, b: str) -> float:
    """0 to 100: the best of sorted words, word sets and, for longer names, the best part; few shared words cap it at 84."""
    x, y = a.split(), b.split()
    if not x or not y:
        return 0.0
    best = _ratio(" ".join(sorted(x)), " ".join(sorted(y)))
    shared = " ".join(sorted(set(x) & set(y)))
    if shared:
        best = max(best, *(_ratio(shared, " ".join([shared, *sorted(set(z) - set(shared.split()))]).strip()) for z in (x, y)))
    short, long_ = sorted((a, b), key=len)
    if len(short) >= 4 and min(len(x), len(y)) >= 2:
        best = max(best, *(_ratio(short, long_[i : i + len(short)]) for i in range(len(long_) - len(short) + 1)))
    if min(len(x), len(y)) == 1 and len(x) != len(y) and not shared:
        best = min(best, 84.0)
    return min(best, 84.0) if token_f1(a, b) < 0.40 else best


def fuzzy_score(a: Column, b: Column) -> Column:
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([fuzzy(p or "", q or "") for p, q in zip(x, y, strict=True)])

    of.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(of, "double")(a, b)
