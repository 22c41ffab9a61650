"""Scans that give code-point positions: lines, phrases, matches near a place."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.text import WORD


def line_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ord, start, end, core``: each line without its end; no empty line behind the last end."""
    lines = df.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("ord", "line"))
    before = W.partitionBy("doc_id").orderBy("ord")
    start = F.sum(F.length("line") + 1).over(before.rowsBetween(W.unboundedPreceding, -1))
    last = F.lead("ord").over(before).isNull() & (F.col("line") == "")
    core = F.regexp_replace("line", "\r+$", "")
    out = lines.select("doc_id", "ord", F.coalesce(start, F.lit(0)).cast("int").alias("start"), core.alias("core"), last.alias("last"))
    return out.where(~F.col("last")).select("doc_id", "ord", "start", (F.col("start") + F.length("core")).alias("end"), "core")


def lowered(text: Column) -> Column:
    """Lower case with every character at its place: U+0130, whose lower case is two characters, becomes i."""
    return F.lower(F.translate(text, "İ", "i"))


def _hides(phrase: str) -> bool:
    """Whether a place of the phrase that a word touches can cover a part of one that none touches.

    That takes a phrase that ends as it begins, with no word character in front of that ending.
    """
    return any(phrase[k:] == phrase[:-k] and not re.match(r"\w", phrase[k - 1]) for k in range(1, len(phrase)))


def phrase_occurrences(df: DataFrame, phrases: Sequence[str], doc_id: str = "doc_id", text: str = "text", boundary: bool = True) -> DataFrame:
    """``doc_id, phrase, start, end``: left-to-right occurrences that don't overlap, of any case, at their places in the text as it is.

    ``boundary`` keeps those that no word character touches; texts are split at these alone where that
    can't change which they are. Only lengths and border characters are shuffled, not the texts.
    """
    low = {p: p.replace("İ", "i").lower() for p in phrases}
    asked = df.select(F.col(doc_id).alias("doc_id"), lowered(F.col(text)).alias("low"), F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(boundary and not _hides(p)).alias("whole")) for p in dict.fromkeys(low.values())])).alias("p"))
    asked = asked.select("doc_id", "low", "p.phrase", "p.whole").where(F.contains("low", F.col("phrase")))
    quoted = F.concat(F.lit("\\Q"), F.col("phrase"), F.lit("\\E"))
    at = F.when(F.col("whole"), F.concat(quoted, F.lit(f"(?!{WORD})(?<!{WORD}"), quoted, F.lit(")"))).otherwise(quoted)
    pieces = asked.select("doc_id", "phrase", "whole", F.posexplode(F.split("low", at, F.lit(-1))).alias("ord", "piece"))
    pieces = pieces.select("doc_id", "phrase", "whole", "ord", F.length("piece").alias("n"), F.left("piece", F.lit(1)).alias("head"), F.right("piece", F.lit(1)).alias("tail"))
    w = W.partitionBy("doc_id", "phrase").orderBy("ord")
    size = F.length("phrase")
    start = F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("ord") * size
    # an empty piece lies between two hits that touch, or at an end of the text
    left = F.when((F.col("n") > 0) | (F.col("ord") == 0), F.col("tail")).otherwise(F.right("phrase", F.lit(1)))
    next_n, next_head, after = F.lead("n").over(w), F.lead("head").over(w), F.lead("ord", 2).over(w)
    right = F.when((next_n > 0) | after.isNull(), next_head).otherwise(F.left("phrase", F.lit(1)))
    hits = pieces.select("doc_id", "phrase", "whole", start.cast("int").alias("start"), left.alias("l"), right.alias("r"), next_n.alias("more")).where("more is not null")
    if boundary:
        hits = hits.where(F.col("whole") | (~F.col("l").rlike(WORD) & ~F.col("r").rlike(WORD)))
    return hits.select("doc_id", "phrase", "start", (F.col("start") + F.length("phrase")).alias("end"))


def overlapping_starts(text: Column, phrase: Column, lo: Column, hi: Column) -> Column:
    """All starts of ``phrase`` in ``text[lo:hi]``, also overlapping ones."""
    last = hi - F.length(phrase)
    return F.when(last < lo, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(lo, last), lambda i: F.substring(text, i + 1, F.length(phrase)) == phrase))
