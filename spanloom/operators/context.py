"""Sections, roles, genres and the flags that the context of a span gives it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.text import WORD


def heading_of(core: Column, cues: dict[str, str]) -> Column:
    """The category of the longest cue that a line begins with, numbering and bullets aside; null without one.

    Behind the cue the line ends or has one of ``: - / , . ( *`` or a blank. A cue that something is
    glued to counts only if a shorter cue also begins the line.
    """
    line = F.lower(F.regexp_replace(core, r"^[\s\-•*0-9.)]+", ""))
    out, shorter = F.lit(None).cast("string"), F.lit(False)
    for cue in sorted(cues, key=len):
        begins = line.startswith(cue)
        after = F.substring(line, len(cue) + 1, 1)
        clean = after.isin("", ":", " ", "-", "/", ",", ".", "(", "*")
        out = F.when(begins & (clean | shorter), cues[cue]).otherwise(out)
        shorter = shorter | begins
    return out


def sections(lines: DataFrame, lengths: DataFrame, cues: dict[str, str]) -> DataFrame:
    """``doc_id, start, end, category`` from lines (doc_id, start, core): ROOT, then each heading's section."""
    heads = lines.select("doc_id", "start", heading_of(F.col("core"), cues).alias("category"), F.lit(None).cast("int").alias("n"), F.lit(False).alias("root")).where("category is not null")
    roots = lengths.select("doc_id", F.lit(0).alias("start"), F.lit("ROOT").alias("category"), F.col("n").cast("int").alias("n"), F.lit(True).alias("root"))
    # every document's ROOT comes first and tells its length; a heading at 0 takes its place. Both sides are
    # united before they are dealt by document: a union of dealt sides has the partitions of both under adaptive plans
    per = W.partitionBy("doc_id")
    nxt = F.lead("start").over(per.orderBy("start", F.desc("root")))
    both = roots.unionByName(heads).where("doc_id is not null").select("doc_id", "start", "category", "root", nxt.alias("next"), F.max("n").over(per).alias("n"), F.max("root").over(per).alias("known"))
    return both.where(F.col("known") & ~(F.col("root") & F.coalesce(F.col("next") == 0, F.lit(False)))).select("doc_id", "start", F.coalesce("next", "n").alias("end"), "category")


def genre(role_at: Column, faq: Column, n_sections: Column) -> Column:
    """Q&A where a role marker is first, HYBRID where it comes later, FAQ by its lead, EHR by two sections."""
    return F.when(role_at == 0, "QA").when(role_at > 0, "HYBRID").when(faq, "FAQ").when(n_sections >= 2, "EHR").otherwise("FREE_TEXT")


def sticky(rows: DataFrame, value: str, by: str, order: str) -> Column:
    """The last value that was said, up to this row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


def segments(bounds: DataFrame, lengths: DataFrame) -> DataFrame:
    """``doc_id, start, end, role, section``: stretches between bounds (doc_id, start, role, section); a role holds until the next."""
    one = bounds.groupBy("doc_id", "start").agg(F.max("role").alias("role"), F.max("section").alias("section")).join(lengths, "doc_id")
    w = W.partitionBy("doc_id").orderBy("start")
    out = one.select("doc_id", "start", F.coalesce(F.lead("start").over(w), F.col("n")).alias("end"), F.last("role", True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("role"), F.last("section", True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("section"))
    return out.where("end > start")


def _quoted(words: list[str]) -> str:
    return "(?:" + "|".join(rf"\Q{w}\E" for w in sorted(words, key=len, reverse=True)) + ")"


def _not_before(exceptions: list[str]) -> str:
    return rf"(?!\s*+{_quoted(exceptions)})" if exceptions else ""


def any_cue(window: Column, cues: list[str], exceptions: list[str]) -> Column:
    """Whether some place of a cue in a window isn't followed by an exception right behind it."""
    return window.rlike(f"(?s){_quoted(cues)}{_not_before(exceptions)}") if cues else F.lit(False)


def last_cue_scope(window: Column, cues: list[str], exceptions: list[str]) -> Column:
    """Whether some cue's last hit in a window isn't followed by an exception right behind the cue."""
    out = F.lit(False)
    for cue in sorted(cues, key=len, reverse=True):
        out = out | window.rlike(f"(?s)^(?>.*{_quoted([cue])}){_not_before(exceptions)}")
    return out


def last_subject(window: Column, subjects: list[str], masked: list[str], blockers: list[str]) -> Column:
    """Whether some subject stands in a window as a whole word and no blocker stands in or behind the last one.

    Masked phrases are blanked first.
    """
    for phrase in masked:
        window = F.replace(window, F.lit(phrase), F.lit(" " * len(phrase)))
    tail = F.regexp_extract(window, rf"(?s)^(?>.*(?<!{WORD})(?={_quoted(subjects)}(?!{WORD})))(.*)$", 1)
    blocked = F.lit(False)
    for b in blockers:
        blocked = blocked | F.contains(tail, F.lit(b))
    return (tail != "") & ~blocked


def route(marker_at: Column, faq: Column, headers: Column, numbered: Column, advice: Column, opening: int = 15) -> Column:
    """Five routes: QA where a role marker opens the text, HYBRID_QA where it comes later, FAQ by its lead,
    HYBRID_CONSULT for one kind of header at most, one numbered heading at most and advice; else NOTE."""
    consult = (headers > 0) & (headers <= 1) & (numbered <= 1) & advice
    return F.when(marker_at.between(0, opening), "QA").when(marker_at > opening, "HYBRID_QA").when(faq, "FAQ").when(consult, "HYBRID_CONSULT").otherwise("NOTE")


def flags(historical: Column, negated: Column, family: Column, allowed: Column) -> Column:
    """Flags in their fixed order, none where a type can't have any."""
    some = F.array_compact(F.array(F.when(historical, "isHistorical"), F.when(negated, "isNegated"), F.when(family, "isFamily")))
    return F.when(allowed, some).otherwise(F.array().cast("array<string>"))
