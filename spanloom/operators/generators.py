"""Span generators: measured values behind names, dose runs, chunks, markup, and surfaces back to places."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from . import occurrences

# Rows, or characters of segmented texts, that a batch of results holds before it goes on.
ROWS, CHARS = 1 << 16, 1 << 20

# Words between a name and its value, signs and words between two numbers of a range, numerators and denominators of units, units alone.
LINKS = ("là", "đo được", "ở mức", "khoảng", "tăng lên", "tăng từ", "giảm xuống", "giảm còn", "nâng cao lên", ":")
RANGES = ("-->", "->", "→", "–", "-", "đến", "lên", "tới")
RATIOS = (("mmol", "l"), ("mg", "dl"), ("mg", "l"), ("meq", "l"), ("g", "l"), ("k", "ul"), ("", "ul"), ("", "mm3"), ("u", "l"), ("ui", "l"), ("iu", "l"))
PLAIN_UNITS = ("mmhg", "bpm", "mcg", "mg", "ml", "g", "iu", "%")


def _any_of(words) -> str:
    return "(?:" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words) + ")"


def value_pattern() -> str:
    """A number or range of numbers with a whole unit behind it, if there is one."""
    number = "[0-9]+(?:[.,][0-9]+)?"
    unit = "|".join([*(rf"{a}\s*/\s*{b}" if a else rf"/\s*{b}" for a, b in RATIOS), *PLAIN_UNITS])
    return rf"{number}(?:\s*{_any_of(RANGES)}\s*{number})*(?:\s*(?:{unit})(?!{occurrences.WORD}))?"


CONNECTOR, VALUE = rf"^[\s:]*{_any_of(LINKS)}?\s*", value_pattern()


def windows_of(hits: DataFrame, docs: DataFrame, window: Callable[[Column, Column], Column], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``hits`` with ``window``: a stretch of the text that ``window(body, hit)`` cuts for each of them.

    The hits of a document travel together, so each text is joined once and not once per hit.
    """
    rest = [c for c in hits.columns if c != "doc_id"]
    lists = hits.groupBy("doc_id").agg(F.collect_list(F.struct(*rest)).alias("hits"))
    both = lists.join(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body")), "doc_id")
    cut = both.select("doc_id", F.explode(F.transform("hits", lambda h: F.struct(h.alias("hit"), window(F.col("body"), h).alias("window")))).alias("x"))
    return cut.select("doc_id", *[F.col(f"x.hit.{c}").alias(c) for c in rest], F.col("x.window").alias("window"))


def name_values(docs: DataFrame, names: list[str], doc_id: str = "doc_id", text: str = "text", ahead: int = 60) -> DataFrame:
    """``doc_id, phrase, start, end, value, value_start``: the value behind each name, if it comes at once.

    A name's window ends at the next name, a line end, a semicolon or ``ahead`` characters.
    """
    hits = occurrences.phrase_occurrences(docs, names, doc_id, text)
    nxt = F.lead("start").over(W.partitionBy("doc_id").orderBy("start", "end"))
    rows = hits.withColumn("bound", F.least(F.coalesce(nxt, F.col("end") + ahead), F.col("end") + ahead))
    rows = windows_of(rows, docs, lambda body, h: F.regexp_extract(F.substring(body, h.end + 1, F.greatest(h.bound - h.end, F.lit(0))), r"^[^\n;]*", 0), doc_id, text)
    lead = F.length(F.regexp_extract("window", "(?iU)" + CONNECTOR, 0))
    value = F.regexp_extract(F.substring("window", lead + 1, F.lit(ahead)), "(?iU)^" + VALUE, 0)
    out = rows.select("doc_id", "phrase", "start", "end", value.alias("value"), (F.col("end") + lead).alias("value_start"))
    return out.where("value != ''")


def chunk_places(text: str, size: int = 1100, overlap: int = 400) -> list[tuple[int, int]]:
    """Places of chunks of at most ``size`` that end before the last blank of their last ``overlap`` characters, if there is one."""
    out, at = [], 0
    while at < len(text) or not out:
        end = min(len(text), at + size)
        if end < len(text):
            blank = text.rfind(" ", at + size - overlap, end)
            end = blank if blank > at else end
        out.append((at, end))
        at = end
    return out


def chunks(text: Column, size: int = 1100, overlap: int = 400) -> Column:
    """``array<struct<start, end>>`` of :func:`chunk_places`; the chunks join to the whole text. A null text has none, an empty one an empty one."""

    def of(x: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in chunk_places(v, size, overlap)] if v is not None else [] for v in x])

    of.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(of, "array<struct<start:int,end:int>>")(text)


_WORD_START = re.compile(r"(?<![^\W_])[^\W_]")


@lru_cache(maxsize=8)
def _dose_patterns(names: tuple[str, ...], tail: str) -> tuple[re.Pattern, re.Pattern]:
    known = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    return re.compile(known), re.compile(rf"(?:\s*(?:{tail}))+", re.IGNORECASE)


def dose_runs(text: str, names: dict[str, str], tail: str) -> list[tuple[int, int, str]]:
    """Places of names at word starts (the longest first), widened by what ``tail`` matches behind them.

    A name that is glued to the last one counts too; the search goes on behind a run.
    """
    low, out = text.replace("İ", "i").lower(), []
    known, more = _dose_patterns(tuple(names), tail)
    done = 0
    for m in _WORD_START.finditer(low):
        at = m.start()
        while at >= done and at < len(low) and low[at].isalnum() and (name := known.match(low, at)):
            behind = more.match(text, name.end())
            done = behind.end() if behind else name.end()
            out.append((at, done, names[name[0]]))
            at = done
    return out


def dose_spans(docs: DataFrame, names: dict[str, str], tail: str) -> DataFrame:
    """``doc_id, start, end, canonical`` of :func:`dose_runs` over whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, *r) for d, x in zip(b["doc_id"], b["text"], strict=True) if x for r in dose_runs(x, names, tail)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "canonical"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, start int, end int, canonical string")


def rule_union(*parts: DataFrame) -> DataFrame:
    """The spans ``doc_id, start, end, type, text, source`` of several rules, equal ones once, by the first rule that found them."""
    rows = None
    for i, part in enumerate(parts):
        one = part.select("doc_id", "start", "end", "type", "text", "source", F.lit(i).alias("rule"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("doc_id", "start", "end", "type", "text").agg(F.min_by("source", "rule").alias("source"))


def parsed_markup(marked: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """``doc_id, text, spans, error`` of rows ``doc_id, marked``; spans are ``array<struct<start, end, type, flags>>``.

    Spans of a type that isn't among ``types`` are left out, their text stays. A text whose marks don't
    fit has null text and spans, and says why.
    """
    kind = marked.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, spans array<struct<start:int,end:int,type:string,flags:array<string>>>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, x in zip(b["doc_id"], b["marked"], strict=True):
                try:
                    text, spans = parse_markup(x or "")
                    rows.append((d, text, [{"start": s, "end": e, "type": k, "flags": f} for s, e, k, f in spans if types is None or k in types], None))
                except ValueError as problem:
                    rows.append((d, None, None, str(problem)))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "spans", "error"])

    return marked.select("doc_id", "marked").mapInPandas(run, schema)


MARK = re.compile(r"⟦/⟧|⟦([^⟦⟧|/]+)(?:\|([^⟦⟧]*))?⟧|⟧|⟦")


def parse_markup(marked: str) -> tuple[str, list[tuple[int, int, str, list[str]]]]:
    """Clean text and spans of ``⟦TYPE|a,b⟧surface⟦/⟧``; a lone closing sign closes, stray signs vanish.

    A span that is never closed is an error.
    """
    clean, spans, open_, at = "", [], None, 0
    for m in MARK.finditer(marked):
        clean += marked[at : m.start()]
        at = m.end()
        if m[1]:
            if open_:
                raise ValueError("a span begins inside another one")
            open_ = (len(clean), m[1], [f for f in (m[2] or "").split(",") if f])
        elif m[0] in ("⟦/⟧", "⟧") and open_:
            spans.append((open_[0], len(clean), open_[1], open_[2]))
            open_ = None
    if open_:
        raise ValueError("a span isn't closed")
    return clean + marked[at:], spans


def relocate(items: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, ord, surface, start, end``: the nth mention of a surface goes to its nth place in the text.

    Items beyond the last place are dropped. Places are found by lower case and don't overlap; surfaces
    of one or two characters have to match exactly. A document's items travel together, its text once.
    """
    lists = items.groupBy("doc_id").agg(F.collect_list(F.struct("ord", "surface")).alias("items"))
    return relocate_lists(lists.join(docs.select("doc_id", "text").where("text is not null"), "doc_id"))


def relocated(text: str, wanted: list[tuple]) -> Iterator[tuple]:
    """``ord, surface, start, end`` of the mentions ``ord, surface`` that have a place; see :func:`relocate`."""
    low, behind = text.replace("İ", "i").lower(), {}
    for order, surface in wanted:
        exact = len(surface) <= 2
        phrase = surface if exact else surface.replace("İ", "i").lower()
        at = (text if exact else low).find(phrase, behind.get(phrase, 0)) if phrase else -1
        behind[phrase] = at + len(phrase) if at >= 0 else len(text) + 1
        if at >= 0:
            yield order, surface, at, at + len(phrase)


def relocate_lists(docs: DataFrame) -> DataFrame:
    """:func:`relocate` where each text already has its mentions beside it: ``doc_id, text, items array<struct<ord, surface>>``.

    One document at a time is unpacked, and rows go on in batches of bounded size.
    """
    fields = {"doc_id": docs.schema["doc_id"].dataType, **{f.name: f.dataType for f in docs.schema["items"].dataType.elementType if f.name == "ord"}}
    schema = f"doc_id {fields['doc_id'].simpleString()}, ord {fields['ord'].simpleString()}, surface string, start int, end int"
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], [], [], []]
        for b in batches:
            ids, texts, items = (b.column(c) for c in ("doc_id", "text", "items"))
            for i in range(b.num_rows):
                if not (texts[i].is_valid and items[i].is_valid):
                    continue
                wanted = items[i].values
                pairs = sorted(zip(wanted.field("ord").to_pylist(), wanted.field("surface").to_pylist(), strict=True), key=lambda x: x[0])
                d, before = ids[i].as_py(), len(rows[1])
                for r in relocated(texts[i].as_py(), pairs):
                    for column, v in zip(rows[1:], r, strict=True):
                        column.append(v)
                rows[0] += [d] * (len(rows[1]) - before)
                if len(rows[0]) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, kinds, strict=True)], schema=kinds)
                    rows = [[], [], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, kinds, strict=True)], schema=kinds)

    return docs.select("doc_id", "text", "items").mapInArrow(run, schema)


def segmented(docs: DataFrame, lexicon: Sequence[str], longest: int = 4) -> DataFrame:
    """``doc_id, segmented, seg2raw``: words of a lexicon phrase joined by ``_``, and the raw place of each character of the result.

    Words are runs without white space; the longest phrase of at most ``longest`` words wins. One blank
    stands between words, one line end where the text has some; these and the joining signs have no raw
    place (null) unless they are one in the text.
    """
    known = {tuple(p.lower().split()) for p in lexicon}
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(text: str) -> tuple[str, list[int | None]]:
        words = [(m[0], m.start()) for m in re.finditer(r"\S+", text)]
        out, places, i = [], [], 0
        while i < len(words):
            n = next((n for n in range(min(longest, len(words) - i), 1, -1) if tuple(w.lower() for w, _ in words[i : i + n]) in known and "\n" not in text[words[i][1] : words[i + n - 1][1]]), 1)
            if i:
                end = words[i - 1][1] + len(words[i - 1][0])
                gap = text[end : words[i][1]]
                out.append("\n" if "\n" in gap else " ")
                places.append(end if len(gap) == 1 else None)
            for k in range(i, i + n):
                if k > i:
                    out.append("_")
                    places.append(None)
                out.append(words[k][0])
                places += range(words[k][1], words[k][1] + len(words[k][0]))
            i += n
        return "".join(out), places

    schema = f"doc_id {kind}, segmented string, seg2raw array<int>"
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def made(ids: list, texts: list, places: list, ends: list) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(places) if places else pa.array([], pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(ids, kinds[0].type), pa.array(texts, kinds[1].type), lists.cast(kinds[2].type)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, places, ends = [], [], [], [0]
        for b in batches:
            for d, x in zip(b.column("doc_id"), b.column("text"), strict=True):
                text, at = cut(x.as_py() or "")
                ids.append(d.as_py())
                texts.append(text)
                places.append(pa.array(at, pa.int32()))
                ends.append(ends[-1] + len(at))
                if ends[-1] >= CHARS:
                    yield made(ids, texts, places, ends)
                    ids, texts, places, ends = [], [], [], [0]
        yield made(ids, texts, places, ends)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def raw_places(seg2raw: Column, start: Column, end: Column) -> Column:
    """A span of segmented text in raw text, by the raw place of each character (null for inserted ones)."""
    known = F.filter(F.slice(seg2raw, start + 1, end - start), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.struct(F.array_min(known).alias("start"), (F.array_max(known) + 1).alias("end")))
