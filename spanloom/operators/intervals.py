"""Interval algebra over spans ``doc_id, start, end, type, ord, ...``; ``end`` is exclusive.

Set-like steps are grouped aggregates and windows. Steps whose result depends on what was kept so
far (greedy ones) fold over one document's spans in order, with Arrow batches per document.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("doc_id", "start", "end", "type")


def dedup_exact(spans: DataFrame) -> DataFrame:
    """One row per (doc, start, end, type): flags united, the first candidates that aren't empty."""
    first = F.expr("min_by(candidates, ord) filter (where size(candidates) > 0)")
    flags = F.array_sort(F.array_distinct(F.flatten(F.collect_list("assertions"))))
    return spans.groupBy(*KEY).agg(flags.alias("assertions"), F.coalesce(first, F.array().cast("array<string>")).alias("candidates"), F.min("ord").alias("ord"))


def drop_nested(spans: DataFrame) -> DataFrame:
    """Without spans that a strictly longer span of the document contains.

    In order of start and falling end, a span is contained exactly if some end before it reaches its own.
    """
    order = W.partitionBy("doc_id").orderBy("start", F.col("end").desc())
    seen = spans.select("doc_id", "start", "end").distinct()
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    kept = seen.withColumn("reach", reach).where("reach is null or reach < end").drop("reach")
    return spans.join(kept, ["doc_id", "start", "end"], "left_semi")


def same_span_priority(spans: DataFrame, priority: list[str]) -> DataFrame:
    """One row per (doc, start, end): the type that ``priority`` names first, ties by ``ord``."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("type"))
    rest = [F.col(c) for c in spans.columns if c not in ("doc_id", "start", "end")]
    best = F.min_by(F.struct(*rest), F.struct(F.when(rank == 0, len(priority) + 1).otherwise(rank), F.col("ord")))
    return spans.groupBy("doc_id", "start", "end").agg(best.alias("x")).select("doc_id", "start", "end", "x.*")


def harmonize_types(spans: DataFrame, linkable: list[str]) -> DataFrame:
    """Equal normalised texts of a document get their commonest type.

    Ties go to the first of ``linkable``, else to the type that comes first.
    """
    votes = spans.groupBy("doc_id", "text", "type").agg(F.count("*").alias("n"), F.min(F.struct("start", "ord")).alias("at"))
    rank = F.array_position(F.array(*[F.lit(x) for x in linkable]), F.col("type"))
    won = votes.groupBy("doc_id", "text").agg(F.min_by("type", F.struct(-F.col("n"), F.when(rank == 0, 99).otherwise(rank), "at")).alias("won"))
    return spans.join(won, ["doc_id", "text"]).withColumn("type", F.col("won")).drop("won")


def gap_merge(spans: DataFrame, kind: str, gap: int = 30, broken: Column | None = None) -> DataFrame:
    """``doc_id, type, start, end, parts``: neighbours of one type ``kind`` with 1 to ``gap`` between become one.

    ``broken`` is an expression over a row and ``prev_end`` that keeps two neighbours apart.
    """
    order = W.partitionBy("doc_id").orderBy("start", "end", "ord")
    rows = spans.withColumn("prev_end", F.lag("end").over(order)).withColumn("prev_type", F.lag("type").over(order))
    between = F.col("start") - F.col("prev_end")
    goes_on = (F.col("type") == kind) & (F.col("prev_type") == kind) & (between > 0) & (between <= gap)
    if broken is not None:
        goes_on = goes_on & ~broken
    island = F.sum(F.when(goes_on, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("go", goes_on).withColumn("island", island)
    return rows.groupBy("doc_id", "island").agg(F.min("type").alias("type"), F.min("start").alias("start"), F.max_by("end", F.struct("start", "end", "ord")).alias("end"), F.count("*").alias("parts")).drop("island")


def overlap_amount(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def partial_overlaps(spans: DataFrame, bin_size: int = 64) -> DataFrame:
    """``doc_id, left, right, amount``: pairs that overlap without one containing the other.

    Spans meet in bins of positions, so a long document is many small groups; a pair counts in the bin
    where the overlap begins.
    """
    binned = spans.select("doc_id", "ord", "start", "end", F.explode(F.sequence((F.col("start") / bin_size).cast("int"), ((F.col("end") - 1) / bin_size).cast("int"))).alias("bin"))
    a = binned.select("doc_id", "bin", F.col("ord").alias("left"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    b = binned.select("doc_id", "bin", F.col("ord").alias("right"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    crossing = (F.col("s1") < F.col("s2")) & (F.col("s2") < F.col("e1")) & (F.col("e1") < F.col("e2")) & (F.col("bin") == (F.col("s2") / bin_size).cast("int"))
    return a.join(b, ["doc_id", "bin"]).where(crossing).select("doc_id", "left", "right", (F.col("e1") - F.col("s2")).alias("amount"))


def adjacent_overlaps(spans: DataFrame) -> DataFrame:
    """Spans that begin before their left neighbour ends."""
    before = F.lag("end").over(W.partitionBy("doc_id").orderBy("start", "end", "ord"))
    return spans.withColumn("prev_end", before).where("prev_end > start").drop("prev_end")


def section_at(points: DataFrame, sections: DataFrame) -> DataFrame:
    """``points`` (doc_id, pos, ...) with the category of the last section that starts at or before them.

    Both sides are united and read once in order, so no point meets every section.
    """
    cols = [c for c in points.columns if c not in ("doc_id", "pos")]
    p = points.select("doc_id", "pos", F.lit(1).alias("late"), F.lit(None).cast("string").alias("category"), F.struct(*cols).alias("row"))
    s = sections.select("doc_id", F.col("start").cast(points.schema["pos"].dataType).alias("pos"), F.lit(0).alias("late"), "category", F.lit(None).cast(p.schema["row"].dataType).alias("row"))
    w = W.partitionBy("doc_id").orderBy("pos", "late").rowsBetween(W.unboundedPreceding, 0)
    both = p.unionByName(s).withColumn("category", F.last("category", ignorenulls=True).over(w)).where("late = 1")
    return both.select("doc_id", "pos", "row.*", "category")


def _per_document(spans: DataFrame, choose: Callable[[pd.DataFrame], list[int]], order: list[str]) -> DataFrame:
    """The rows of each document that ``choose`` names, by their places in the given order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        return rows.iloc[choose(rows)]

    return spans.groupBy("doc_id").applyInPandas(run, spans.schema)


def _longest_first(rows: pd.DataFrame, same_type: bool) -> list[int]:
    """Places of the rows that are kept: longest first, none that overlaps a kept one.

    What is kept doesn't overlap, so only the two neighbours of a span can.
    """
    start, end = rows["start"].tolist(), rows["end"].tolist()
    kinds = rows["type"].tolist() if same_type else [None] * len(start)
    kept: dict[object, tuple[list[int], list[int]]] = {}
    out = []
    for i in sorted(range(len(start)), key=lambda i: start[i] - end[i]):
        begins, ends = kept.setdefault(kinds[i], ([], []))
        at = bisect_right(begins, start[i])
        if (at == 0 or ends[at - 1] <= start[i]) and (at == len(begins) or begins[at] >= end[i]):
            begins.insert(at, start[i])
            ends.insert(at, end[i])
            out.append(i)
    return out


def collapse_overlapping(spans: DataFrame) -> DataFrame:
    """Of overlapping spans of one type the longest stay, taken longest first, equals by ``ord``."""
    return _per_document(spans, lambda rows: _longest_first(rows, True), ["ord"])


def greedy_fill(spans: DataFrame) -> DataFrame:
    """The longest spans first, of any type, as long as nothing is covered twice."""
    return _per_document(spans, lambda rows: _longest_first(rows, False), ["ord"])


def unite_equal(spans: DataFrame) -> DataFrame:
    """Spans of equal place, type and (if there is one) text become one: lists united, the highest score, the first ``ord``."""
    key = [c for c in (*KEY, "text") if c in spans.columns]
    made = {"score": F.max("score"), "ord": F.min("ord")}
    rest = [c for c in spans.columns if c not in key]
    lists = {f.name for f in spans.schema if f.dataType.typeName() == "array"}
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))) if c in lists else made.get(c, F.min_by(c, "ord")) for c in rest]
    return spans.groupBy(*key).agg(*[u.alias(c) for u, c in zip(united, rest, strict=True)]).select(*spans.columns)


def resolve_by_score(spans: DataFrame) -> DataFrame:
    """Equal spans are united; then, in order of start, a span that overlaps a kept one of its type replaces it if it scores higher, or equal and is longer.

    Only the first kept span that it overlaps counts.
    """

    def choose(rows: pd.DataFrame) -> list[int]:
        start, end, kinds, scores = (rows[c].tolist() for c in ("start", "end", "type", "score"))
        kept: list[int] = []
        open_: dict[str, list[int]] = {}  # places in kept whose spans may still be overlapped
        for i in range(len(start)):
            mine = [k for k in open_.get(kinds[i], []) if end[kept[k]] > start[i]]
            at = next((k for k in mine if start[kept[k]] < end[i]), None)
            if at is None:
                mine.append(len(kept))
                kept.append(i)
            elif (scores[i], end[i] - start[i]) > (scores[kept[at]], end[kept[at]] - start[kept[at]]):
                kept[at] = i
            open_[kinds[i]] = mine
        return kept

    rows = unite_equal(spans)
    return _per_document(rows.withColumn("_falling", -F.col("score")), choose, ["start", "end", "type", "_falling", "ord"]).drop("_falling")


def split_concatenated(spans: DataFrame, lexicon: list[tuple[str, str]], least: int = 8, share: float = 0.8) -> DataFrame:
    """A span that two or more lexicon phrases of its type cover to ``share`` becomes these phrases.

    Each phrase counts at its first place; phrases are taken from the left, the shorter of two that begin together.
    """
    by_type: dict[str, list[str]] = {}
    for kind, phrase in lexicon:
        by_type.setdefault(kind, []).append(phrase)

    def parts_of(kind: str, body: str) -> list[tuple[int, str]]:
        known = by_type.get(kind, [])
        if len(body) < least or body in known:
            return []
        parts, at = [], 0
        for begin, p in sorted(((body.find(p), p) for p in known if p in body), key=lambda h: (h[0], len(h[1]))):
            if begin >= at:
                parts.append((begin, p))
                at = begin + len(p)
        return parts if len(parts) > 1 and sum(len(p) for _, p in parts) >= share * len(body) else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [parts_of(k, x) for k, x in zip(b["type"], b["text"], strict=True)]
            out = b.loc[b.index.repeat([max(1, len(f)) for f in found])].reset_index(drop=True)
            flat = [p for f in found for p in (f or [(0, None)])]
            split = [p is not None for _, p in flat]
            start = out["start"] + [s for s, _ in flat]
            out["text"] = [p if p is not None else x for (_, p), x in zip(flat, out["text"], strict=True)]
            out["end"] = np.where(split, start + out["text"].str.len(), out["end"])
            out["start"] = start
            yield out

    return spans.mapInPandas(run, spans.schema)


def _with_texts(spans: DataFrame, texts: DataFrame, fold: Callable[[list[dict], str], list[dict]], order: list[str]) -> DataFrame:
    """``fold`` over each document's spans, in order, and its text; a text travels once, not once per span."""
    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*spans.columns)).alias("spans"))
    both = lists.join(texts.select("doc_id", F.col("text").alias("body")), "doc_id").select("spans", "body")
    columns = spans.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for spans_, body in zip(b["spans"], b["body"], strict=True) for r in fold(sorted((dict(x) for x in spans_), key=lambda r: [r[c] for c in order]), body)]
            yield pd.DataFrame(rows, columns=columns)

    return both.mapInPandas(run, spans.schema)


def merge_fragments(spans: DataFrame, texts: DataFrame, lexicon: list[tuple[str, str]], most: int = 6, gap: int = 5, before: int = 3, after: int = 6) -> DataFrame:
    """Up to ``most`` neighbours of one type that a lexicon phrase covers become one span at the phrase's place.

    Neighbours are at most ``gap`` apart. The phrase lies within ``before`` and ``after`` characters of
    the group's ends and leaves out one character at most on either side. More spans are better, then a
    longer phrase, then a nearer one.
    """
    by_type: dict[str, list[str]] = {}
    for kind, phrase in lexicon:
        by_type.setdefault(kind, []).append(phrase)

    def best_cover(body: str, kind: str, begin: int, end: int) -> tuple[int, int, int, str] | None:
        lo, hi, best = max(0, begin - before), min(len(body), end + after), None
        for phrase in by_type[kind]:
            at = body.find(phrase, lo, hi)
            while at >= 0:
                last = at + len(phrase)
                if at <= begin + 1 and last >= end - 1:
                    rank = (len(phrase), -abs(at - begin) - abs(last - end))
                    if best is None or rank > best[0]:
                        best = (rank, at, last, phrase)
                at = body.find(phrase, at + 1, hi)
        return best

    def fold(rows: list[dict], body: str) -> list[dict]:
        out, i = [], 0
        while i < len(rows):
            found, last = None, i
            while rows[i]["type"] in by_type and last + 1 < min(len(rows), i + most) and rows[last + 1]["type"] == rows[i]["type"] and rows[last + 1]["start"] - rows[last]["end"] <= gap:
                last += 1
                cover = best_cover(body, rows[i]["type"], rows[i]["start"], rows[last]["end"])
                found = (last, cover) if cover else found  # a group of more spans is better
            if found:
                until, (_, begin, end, phrase) = found
                lists = {c: sorted({x for r in rows[i : until + 1] for x in r[c]}) for c, v in rows[i].items() if isinstance(v, (list, np.ndarray))}
                out.append(rows[i] | lists | {"start": begin, "end": end, "text": phrase})
                i = until + 1
            else:
                out.append(rows[i])
                i += 1
        return out

    return _with_texts(spans, texts, fold, ["start", "end", "ord"])


def contained(segments: DataFrame, spans: DataFrame, bin_size: int = 256) -> DataFrame:
    """``segment, local_start, local_end`` and the columns of ``spans`` for spans that lie wholly in a segment (doc_id, segment, s0, e0).

    Both meet in bins of positions, a span in the bin of its start, so a long document is many small groups.
    """
    bins = F.explode(F.sequence((F.col("s0") / bin_size).cast("int"), ((F.greatest(F.col("e0"), F.col("s0") + 1) - 1) / bin_size).cast("int"))).alias("bin")
    cells = segments.select("doc_id", "segment", "s0", "e0", bins)
    inside = (F.col("start") >= F.col("s0")) & (F.col("end") <= F.col("e0"))
    both = spans.withColumn("bin", (F.col("start") / bin_size).cast("int")).join(cells, ["doc_id", "bin"]).where(inside)
    return both.select("segment", (F.col("start") - F.col("s0")).alias("local_start"), (F.col("end") - F.col("s0")).alias("local_end"), *spans.columns)


def overlapping(left: DataFrame, right: DataFrame, on: list[str], bin_size: int = 64) -> DataFrame:
    """``on, left, right, overlap`` for overlapping spans of equal ``on``, from ``on, ord, start, end`` on both sides.

    Spans meet in bins of positions; a pair counts in the bin where its overlap begins.
    """

    def binned(df: DataFrame, name: str, k: int) -> DataFrame:
        bins = F.explode(F.sequence((F.col("start") / bin_size).cast("int"), ((F.greatest(F.col("end"), F.col("start") + 1) - 1) / bin_size).cast("int"))).alias("bin")
        return df.select(*on, F.col("ord").alias(name), F.col("start").alias(f"s{k}"), F.col("end").alias(f"e{k}"), bins)

    both = binned(left, "left", 1).join(binned(right, "right", 2), [*on, "bin"])
    amount = overlap_amount(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"))
    first = (F.greatest("s1", "s2") / bin_size).cast("int") == F.col("bin")
    return both.where((amount > 0) & first).select(*on, "left", "right", amount.alias("overlap"))


def strip_tail(text: Column, suffixes: list[str]) -> Column:
    """Without trailing punctuation and listed endings, again and again; at least one character stays."""
    ends = "|".join(s.replace(" ", r"\s") for s in suffixes)
    return F.regexp_replace(text, rf"(?s)(?<=.)(?:[:,;.\s]|{ends})+$" if suffixes else r"(?s)(?<=.)[:,;.\s]+$", "")


def cut_at(text: Column, markers: list[str]) -> Column:
    """The text before the first of the markers, in their order, that stands in it but not at its start."""
    out = text
    for m in reversed(markers):
        out = F.when(F.instr(text, m) > 1, F.substring_index(text, m, 1)).otherwise(out)
    return out


def split_name_value(text: Column, link: str = "là", bad: tuple[str, ...] = (",", "cho thấy", "ghi nhận", "phát hiện")) -> Column:
    """``array<struct<part, text>>``: name and value of "name <link> 12", else the text as value."""
    pattern = rf"^(.{{1,50}}?)\s+{link}\s+([0-9].*)$"
    name, value = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    fits = name != ""
    for b in bad:
        fits = fits & ~F.contains(name, F.lit(b))
    return F.when(fits, F.array(F.struct(F.lit("name").alias("part"), name.alias("text")), F.struct(F.lit("value").alias("part"), value.alias("text")))).otherwise(F.array(F.struct(F.lit("value").alias("part"), text.alias("text"))))


def lexicon_repair(spans: DataFrame, texts: DataFrame, lexicon: DataFrame, window: int = 48, ratio: float = 0.5, gain: int = 32) -> DataFrame:
    """Spans moved to the best lexicon phrase of their type near them.

    A phrase counts if it overlaps the span by ``ratio`` of the shorter one. Better is: higher ratio,
    more overlap, smaller move of both borders, a higher sum of the length gained (``gain`` at most) and
    the phrase's number ``n``; then the phrase that comes first in the lexicon (by ``ord`` if it has
    that column, else by name), then the first place. Spans without such a phrase stay.
    """
    from .generators import windows_of

    first = "ord" if "ord" in lexicon.columns else "phrase"
    # only the window is searched: finding a place in a long text is not constant in time
    near = windows_of(spans.select("doc_id", "ord", "type", "start", "end"), texts, lambda body, h: F.substring(body, F.greatest(h.start - window, F.lit(0)) + 1, h.end + window - F.greatest(h.start - window, F.lit(0))))
    words = lexicon.select("type", "phrase", "n", F.col(first).alias("first"))
    found = near.join(words, "type").where(F.contains("window", F.col("phrase")))
    lo = F.greatest(F.col("start") - window, F.lit(0))
    places = F.filter(F.sequence(F.lit(0), F.length("window") - F.length("phrase")), lambda i: F.substring("window", i + 1, F.length("phrase")) == F.col("phrase"))
    hits = found.select("doc_id", "ord", "start", "end", "phrase", "n", "first", F.explode(F.transform(places, lambda i: i + lo)).alias("s"))
    hits = hits.withColumn("e", F.col("s") + F.length("phrase")).withColumn("o", overlap_amount(F.col("start"), F.col("end"), F.col("s"), F.col("e")))
    hits = hits.withColumn("r", F.col("o") / F.least(F.col("end") - F.col("start"), F.length("phrase"))).where((F.col("r") >= ratio) & (F.col("o") > 0))
    moved = F.abs(F.col("s") - F.col("start")) + F.abs(F.col("e") - F.col("end"))
    worth = F.least(F.length("phrase") - (F.col("end") - F.col("start")), F.lit(gain)) + F.col("n")
    best = hits.groupBy("doc_id", "ord").agg(F.min_by(F.struct("s", "e", "phrase"), F.struct(-F.col("r"), -F.col("o"), moved, -worth, "first", "s")).alias("b"))
    out = spans.join(best, ["doc_id", "ord"], "left")
    return out.select("doc_id", "ord", "type", F.coalesce("b.s", "start").alias("start"), F.coalesce("b.e", "end").alias("end"), F.col("b").isNotNull().alias("repaired"))
