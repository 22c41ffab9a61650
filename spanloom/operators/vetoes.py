"""Filters and label repairs: what drops a span, and what moves it to another type or place.

Lists of words are parameters; the defaults are those of the Vietnamese clinical profile.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import WORD, collapse

# Type names.
SYMPTOM, TEST, RESULT, DIAGNOSIS = "TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM", "CHẨN_ĐOÁN"
# States that are no diagnosis, and names that are no test by themselves.
STATES = ("có thai", "co thai", "mang thai", "mãn kinh", "man kinh")
GENERIC_TESTS = ("xét nghiệm", "khám chuyên khoa", "khám lâm sàng", "chẩn đoán hình ảnh", "nhìn bên ngoài")
# Who asks about themselves, how the question goes on, and how it ends.
SELF, ASKING, LINK, SUFFERING, ENDING, POLITE = ("em", "tôi", "toi", "con", "cháu", "chau"), ("có phải", "co phải", "có phai", "co phai"), ("là", "la"), "bị", ("không", "khong"), ("ạ", "a")
# Terms that name a class of things and can't be linked.
CLASS_TERMS = (
    "nsaid", "nsaids", "nitrates", "antibiotic", "antibiotics", "khang sinh", "corticosteroid", "corticosteroids", "opioid", "analgesic",
    "opioid analgesic", "opioid analgesics", "thuoc giam dau opioid",
)


def phrase(words: Sequence[str]) -> str:
    """A group that matches any of the phrases, with any white space between their words."""
    return "(?:" + "|".join(r"\s+".join(re.escape(w) for w in p.split()) for p in sorted(words, key=len, reverse=True)) + ")"


def masked_share(text: Column) -> Column:
    """The share of asterisks in a text without the blanks around it; 0 for a blank one."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(bare == "", 0.0).otherwise(F.length(F.regexp_replace(bare, r"[^*]", "")) / F.length(bare))


def asks_about_self(body: Column, start: Column, end: Column, before: int = 40, after: int = 25) -> Column:
    """Whether a span stands in a question of the kind "do I have ...?", by the characters around it."""
    lead = F.substring(body, F.greatest(start - before, F.lit(0)) + 1, F.least(start, F.lit(before)))
    tail = F.substring(body, end + 1, F.lit(after))
    asked = lead.rlike(rf"(?iU){phrase(SELF)}\s+{phrase(ASKING)}\s+(?:{phrase(LINK)}\s+)?(?:{SUFFERING}\s+)?$")
    return asked & tail.rlike(rf"(?iU)^[^.?]{{0,20}}{phrase(ENDING)}\s*(?:{phrase(POLITE)}\b|\?)")


def veto(kind: Column, text: Column, self_question: Column, diagnosis: str = DIAGNOSIS, test: str = TEST, states: Sequence[str] = STATES, generic: Sequence[str] = GENERIC_TESTS, mask: float = 0.5) -> Column:
    """The first reason that drops a span: state, masked, generic or question; null where it stays."""
    norm = collapse(text)
    return (
        F.when((kind == diagnosis) & norm.rlike(f"(?iU){phrase(states)}"), "state")
        .when((masked_share(text) >= mask) & (masked_share(text) > 0), "masked")
        .when((kind == test) & norm.isin(*generic), "generic")
        .when((kind == diagnosis) & self_question, "question")
    )


def confirmed_drop(kind: Column, text: Column, body: Column, start: Column, end: Column, segment: Column, diagnosis: str = DIAGNOSIS, test: str = TEST, states: Sequence[str] = ("có thai", "mang thai", "mãn kinh"), generic: Sequence[str] = GENERIC_TESTS, heading: tuple[str, str] = ("chẩn đoán hình ảnh", "EHR_LAB"), mask: float = 0.5) -> Column:
    """The first reason that surely drops a span; null without one.

    Masked; a state and nothing else; a generic test, unless it is the ``heading`` of its segment; one or
    two characters inside a word.
    """
    norm, bare = collapse(text), F.trim(text)
    as_heading = (norm == heading[0]) & (segment == heading[1])
    touched = F.substring(body, start, 1).rlike(WORD) & (start > 0) | F.substring(body, end + 1, 1).rlike(WORD)
    return (
        F.when((bare != "") & (masked_share(text) >= mask), "masked")
        .when((kind == diagnosis) & norm.rlike(f"(?iU)^{phrase(states)}$"), "state")
        .when((kind == test) & norm.isin(*generic) & ~as_heading, "generic")
        .when((F.length(bare) <= 2) & touched, "inside")
    )


def not_linkable(tokens: Column, terms: Sequence[str] = CLASS_TERMS) -> Column:
    """Whether a text's tokens (there are some) are all terms of classes."""
    return (F.size(tokens) > 0) & (F.size(F.array_except(tokens, F.array(*[F.lit(x) for x in terms]))) == 0)


def is_diagnosis(kind: Column) -> Column:
    """Whether a type is that of diagnoses, its accents spelled in any way."""
    return kind.startswith("CH") & kind.endswith("N") & F.contains(kind, F.lit("N_")) & F.contains(kind, F.lit("O"))


def without_listed(rows: DataFrame, text: str, listed: DataFrame, norm: str = "norm") -> DataFrame:
    """Rows whose whole normalised text isn't on the list (column ``norm``)."""
    return rows.withColumn("_norm", collapse(F.col(text))).join(listed.select(F.col(norm).alias("_norm")), "_norm", "left_anti").drop("_norm")


@dataclass(frozen=True)
class LabelRules:
    """Phrases for :func:`repaired`; each list may be empty."""

    headers: Sequence[str] = ()  # whole texts that are headings
    events: Sequence[str] = ()  # beginnings of administrative events
    normal: Sequence[str] = ()  # beginnings that say a normal state
    readings: Sequence[str] = ()  # whole texts that name a reading
    reactions: Sequence[str] = ()  # beginnings of reactions, which are symptoms
    habits: tuple[Sequence[str], Sequence[str]] = ((), ())  # verbs at the beginning, and what they go with
    histories: Sequence[str] = ()  # cues in front that aren't part of a span
    procedures: Sequence[str] = ()  # verbs that begin a procedure
    disorders: Sequence[str] = ()  # words that begin a disorder
    reasons: Sequence[str] = ()  # words in front of a procedure's reason
    units: Sequence[str] = ()  # units of measured values


def repaired(spans: DataFrame, rules: LabelRules, symptom: str = SYMPTOM, test: str = TEST, diagnosis: str = DIAGNOSIS, flagged: Sequence[str] = ()) -> DataFrame:
    """``spans`` (doc_id, ord, start, end, type, text) with ``action``, and type, start, end and text as the repair leaves them.

    In this order: headings and events go; symptoms that say a normal state go; symptoms that only name a
    reading are tests; reactions and habits are symptoms; a cue of history in front is cut off (types
    in ``flagged``; the rules below see what is left); a diagnosis that begins with a procedure becomes
    the procedure's reason, or the disorder behind the verb, or goes; symptoms with a measured value go.
    """
    body, kind = F.col("text"), F.col("type")
    bare = F.regexp_replace(body, r"^\s+|\s+$", "")

    def begins(words: Sequence[str], more: str = r"\b") -> Column:
        return bare.rlike(f"(?iU)^{phrase(words)}{more}") if words else F.lit(False)

    whole = lambda words: begins(words, "$")
    habit = begins(rules.habits[0], rf"\s+.*{phrase(rules.habits[1])}") if rules.habits[0] and rules.habits[1] else F.lit(False)
    early = (
        F.when(whole(rules.headers), "header")
        .when(begins(rules.events), "event")
        .when((kind == symptom) & begins(rules.normal), "normal")
        .when((kind == symptom) & whole(rules.readings), "reading")
        .when((kind != symptom) & (begins(rules.reactions) | habit), "symptom")
    )
    cue = F.regexp_extract(body, f"(?iU)^{phrase(rules.histories)}\\s+", 0) if rules.histories else F.lit("")
    cue = F.when(kind.isin(*flagged) & (F.trim(F.substring(body, F.length(cue) + 1, F.length(body))) != ""), cue).otherwise("") if flagged else F.lit("")
    rows = spans.select("*", early.alias("_early"), cue.alias("_cue"))
    rest = F.substring(body, F.length("_cue") + 1, F.length(body))
    clean = F.regexp_replace(rest, r"^\s+|\s+$", "")
    verb = rf"(?iU)^{phrase(rules.procedures)}\b" if rules.procedures else r"(?!)"
    reason = F.trim(F.regexp_extract(clean, rf"(?iU)\b{phrase(rules.reasons)}\s+(.+)$", 1)) if rules.reasons else F.lit("")
    behind = F.regexp_replace(F.regexp_replace(clean, verb, ""), r"^\s+|\s+$", "")
    disorder = behind.rlike(f"(?iU)^{phrase(rules.disorders)}") if rules.disorders else F.lit(False)
    core = F.when(reason != "", reason).when(disorder, behind)
    measured = rest.rlike(rf"(?iU)\s*[0-9]+(?:[.,][0-9]+)?\s*{phrase(rules.units)}") if rules.units else F.lit(False)
    late = (
        F.when((kind == diagnosis) & clean.rlike(verb), F.when(core.isNotNull(), "core").otherwise("procedure"))
        .when((kind == symptom) & measured, "measured")
        .when(F.col("_cue") != "", "history")
        .otherwise("kept")
    )
    action = F.coalesce("_early", late)
    kept = F.when(action == "core", core).when(F.col("_early").isNull(), rest).otherwise(body)
    moved = F.when(action == "core", F.length("_cue") + F.instr(rest, core) - 1).when(F.col("_early").isNull(), F.length("_cue")).otherwise(0)
    done = rows.select(*[c for c in spans.columns if c not in ("start", "end", "type", "text")], action.alias("action"), F.when(action == "reading", test).when(action == "symptom", symptom).otherwise(kind).alias("type"), (F.col("start") + moved).alias("start"), kept.alias("text"))
    done = done.withColumn("end", F.col("start") + F.length("text"))
    return done.where(~F.col("action").isin("header", "event", "normal", "procedure", "measured"))


def reclassified(kind: Column, text: Column, section: Column, line_before: Column, findings: Sequence[str], readings: Sequence[str], cues: Sequence[str], verbs: Sequence[str], plain_symptoms: Sequence[str], sections: Sequence[str] = ("LAB", "IMAGING"), symptom: str = SYMPTOM, result: str = RESULT, diagnosis: str = DIAGNOSIS) -> Column:
    """The type that a span has in its context.

    A diagnosis among ``findings`` is a result in one of the ``sections`` or behind one of the ``verbs`` on
    its line; a diagnosis or symptom that begins with a reading of a device is a result behind one of the
    ``cues`` on its line; a diagnosis among ``plain_symptoms`` is a symptom.
    """
    norm = F.lower(text)
    no = F.lit(False)
    found = (kind == diagnosis) & (norm.isin(*findings) if findings else no) & (F.coalesce(section.isin(*sections), no) | (line_before.rlike(f"(?iU){phrase(verbs)}") if verbs else no))
    read = kind.isin(diagnosis, symptom) & (F.trim(norm).rlike(rf"(?iU)^{phrase(readings)}(?:\b[^,.;]*)?$") if readings else no) & (line_before.rlike(rf"(?iU)\b{phrase(cues)}\b") if cues else no)
    return F.when(found | read, result).when((kind == diagnosis) & (norm.isin(*plain_symptoms) if plain_symptoms else no), symptom).otherwise(kind)
