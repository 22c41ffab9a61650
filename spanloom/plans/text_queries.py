"""Queries over texts, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as t
from spanloom.operators import evaluate as ev
from spanloom.operators import generators as gen
from spanloom.operators import occurrences as occ

from .tables import registry, table

QUERIES, ORACLES, query = registry()


PHRASES = ("the", "of the", "that", "de la", "nicht", "para")
_P = ", ".join(f"'{p}'" for p in PHRASES)


@query(f"""
WITH a AS (SELECT doc_id, lower(replace(text, 'İ', 'i')) AS low, unnest([{_P}]) AS phrase FROM documents),
p AS (SELECT doc_id, phrase, string_split(low, phrase) AS parts, low FROM a WHERE contains(low, phrase)),
s AS (SELECT doc_id, phrase, low, parts, unnest(range(1, len(parts))) AS i FROM p),
h AS (SELECT doc_id, phrase, low, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(phrase) AS INT) AS start FROM s)
SELECT doc_id, phrase, start, CAST(start + length(phrase) AS INT) AS "end" FROM h
WHERE NOT regexp_matches(CASE WHEN start = 0 THEN '' ELSE substr(low, start, 1) END, '[\\p{{L}}\\p{{N}}\\p{{M}}_]')
  AND NOT regexp_matches(substr(low, start + length(phrase) + 1, 1), '[\\p{{L}}\\p{{N}}\\p{{M}}_]')""")
def occ_gazetteer(spark, sf):
    """STR11, STR12, GEN1: every occurrence of a phrase list at word boundaries."""
    return occ.phrase_occurrences(table(spark, sf, "documents"), PHRASES)


@query("""
WITH l AS (SELECT doc_id, unnest(range(0, len(s))) AS ord, s FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
p AS (SELECT doc_id, ord, len(s) AS n, s[ord + 1] AS core, coalesce(list_sum(list_transform(s[1:ord], lambda x: length(x) + 1)), 0) AS start FROM l)
SELECT doc_id, CAST(ord AS INT) AS ord, CAST(start AS INT) AS start, CAST(start + length(core) AS INT) AS "end", md5(core) AS core_md5 FROM p
WHERE NOT (ord = n - 1 AND core = '')""")
def line_spans(spark, sf):
    """STR10: lines with their places."""
    return occ.line_spans(table(spark, sf, "documents")).select("doc_id", "ord", "start", "end", F.md5("core").alias("core_md5"))


@query("SELECT doc_id, md5(replace(lower(strip_accents(text)), 'ß', 'ss')) AS folded FROM documents")
def accent_fold(spark, sf):
    """STR1, STR6: lower case without accents."""
    return table(spark, sf, "documents").select("doc_id", F.md5(t.fold_accents(F.col("text"))).alias("folded"))


@query("SELECT doc_id, md5(translate(strip_accents(text), 'đĐ', 'dD')) AS folded FROM documents")
def accent_fold_all(spark, sf):
    """STR2: without accents and strokes, case kept."""
    return table(spark, sf, "documents").select("doc_id", F.md5(t.fold_all(F.col("text"))).alias("folded"))


_CONS = """trim(regexp_replace(regexp_replace(replace(lower(nfc_normalize(text)), '-', ' '), '[.,;:!?()\\[\\]{}"''`“”‘’/\\\\|_+=~]+', ' ', 'g'), '\\s+', ' ', 'g'))"""


@query(f"SELECT doc_id, md5({_CONS}) AS norm, CAST(length({_CONS}) AS INT) AS n FROM documents")
def norm_conservative(spark, sf):
    """STR3: punctuation and hyphens as blanks."""
    norm = t.normalize_conservative(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(norm).alias("norm"), F.length(norm).alias("n"))


@query(f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  translate(strip_accents({_CONS}), 'đĐ', 'dD'), '\\b(type|typ|tuyp)\\s*(ii|2)\\b', 'tip 2', 'g'), '\\b(type|typ|tuyp)\\s*(i|1)\\b', 'tip 1', 'g'),
  '\\btip\\s*ii\\b', 'tip 2', 'g'), '\\btip\\s*i\\b', 'tip 1', 'g'), '\\bman tinh\\b', 'man', 'g'), '\\s+', ' ', 'g'))) AS norm FROM documents""")
def norm_aggressive(spark, sf):
    """STR4: the lookup key without accents."""
    return table(spark, sf, "documents").select("doc_id", F.md5(t.normalize_aggressive(F.col("text"))).alias("norm"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS norm FROM documents")
def collapse_spaces(spark, sf):
    """STR5: lower case, single blanks."""
    return table(spark, sf, "documents").select("doc_id", F.md5(t.collapse(F.col("text"))).alias("norm"))


@query("SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(translate(lower(trim(text)), 'đ', 'd'), '[a-z]+\\d*'))) AS INT) AS n_words FROM documents")
def surface_words(spark, sf):
    """STR8: how many different plain words a text has."""
    return table(spark, sf, "documents").select("doc_id", F.size(t.surface_words(F.col("text"))).alias("n_words"))


@query("""SELECT p_partkey, p_type, CASE regexp_replace(upper(translate(strip_accents(p_type), 'đĐ', 'dD')), '[^A-Z]+', '_', 'g')
  WHEN 'ECONOMY' THEN 'low' WHEN 'PROMO' THEN 'low' WHEN 'STANDARD' THEN 'mid' WHEN 'LARGE' THEN 'size' WHEN 'SMALL' THEN 'size' WHEN 'MEDIUM' THEN 'size' END AS kind FROM part""")
def canonical_type(spark, sf):
    """STR7: loosely spelled type names as known ones."""
    known = {"ECONOMY": "low", "PROMO": "low", "STANDARD": "mid", "LARGE": "size", "SMALL": "size", "MEDIUM": "size"}
    return table(spark, sf, "part").select("p_partkey", "p_type", t.canonical_type(F.col("p_type"), known).alias("kind"))


#: Every "that" at word boundaries.
_HITS = """p AS (SELECT doc_id, text, lower(replace(text, 'İ', 'i')) AS low FROM documents),
s AS (SELECT doc_id, text, low, string_split(low, 'that') AS parts FROM p WHERE contains(low, 'that')),
i AS (SELECT doc_id, text, low, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * 4)) AS pos FROM s),
h AS (SELECT doc_id, text, low, CAST(pos AS INT) AS pos FROM i
  WHERE NOT regexp_matches(CASE WHEN pos = 0 THEN '' ELSE substr(low, CAST(pos AS INT), 1) END, '[\\p{L}\\p{N}\\p{M}_]') AND NOT regexp_matches(substr(low, CAST(pos AS INT) + 5, 1), '[\\p{L}\\p{N}\\p{M}_]'))"""


def that_hits(spark, sf):
    """Every "that" of every text: ``doc_id, start, end``."""
    return occ.phrase_occurrences(table(spark, sf, "documents"), ["that"]).select("doc_id", "start", "end")


@query(f"WITH {_HITS} SELECT doc_id, pos, CAST(pos - length(regexp_extract(substr(text, 1, pos), '[^.;:\\n\\r()\\[\\]]*$', 0)) AS INT) AS clause FROM h")
def clause_start(spark, sf):
    """STR9: where the clause of every "that" begins."""
    hits = gen.windows_of(that_hits(spark, sf), table(spark, sf, "documents"), lambda body, h: t.clause_start(body, h.start))
    return hits.select("doc_id", F.col("start").alias("pos"), F.col("window").alias("clause"))


@query(f"""WITH {_HITS}, c AS (SELECT doc_id, pos, concat(substr(text, greatest(pos - 220, 0) + 1, least(pos, 220)), '[[', substr(text, pos + 1, 4), ']]', substr(text, pos + 5, 220)) AS c FROM h)
SELECT doc_id, pos, md5(c) AS context_md5, regexp_extract(c, '(?s)\\[\\[(.*?)\\]\\]', 1) AS span, md5(replace(replace(c, '[[', '<ENTITY>'), ']]', '</ENTITY>')) AS prompt_md5 FROM c""")
def context_marks(spark, sf):
    """STR14, STR15, STR16: every "that" marked in its context in two ways, and read back."""
    docs = table(spark, sf, "documents")
    c = gen.windows_of(that_hits(spark, sf), docs, lambda body, h: F.struct(t.context_window(body, h.start, h.end, 220).alias("c"), t.context_window(body, h.start, h.end, 220, ("<ENTITY>", "</ENTITY>")).alias("p")))
    return c.select("doc_id", F.col("start").alias("pos"), F.md5("window.c").alias("context_md5"), t.marked_span(F.col("window.c")).alias("span"), F.md5("window.p").alias("prompt_md5"))


@query(f"""WITH {_HITS} SELECT doc_id, pos, CAST(len(list_filter(range(CAST(greatest(pos - 48, 0) AS BIGINT), CAST(least(length(text), pos + 52) - 2 + 1 AS BIGINT)), lambda i: substr(text, CAST(i + 1 AS INT), 2) = 'ha')) AS INT) AS hits FROM h""")
def nearby_overlapping(spark, sf):
    """STR13: hits near every "that", overlapping ones too."""

    def near(body, h):
        lo = F.greatest(h.start - 48, F.lit(0))
        window = F.substring(body, lo + 1, h.end + 48 - lo)
        return F.size(occ.overlapping_starts(window, F.lit("ha"), F.lit(0), F.length(window)))

    hits = gen.windows_of(that_hits(spark, sf), table(spark, sf, "documents"), near)
    return hits.select("doc_id", F.col("start").alias("pos"), F.col("window").alias("hits"))


@query("""WITH r AS (SELECT event_id, 'answer: ' || props || ' (end' AS response FROM events)
SELECT event_id, CAST(json_extract_string(regexp_extract(response, '\\{[^{}]*\\}', 0), '$.k') AS BIGINT) AS k FROM r""")
def json_field_recover(spark, sf):
    """STR18, FLT11, SRC3: objects found in text around them."""
    events = table(spark, sf, "events").select("event_id", F.concat(F.lit("answer: "), "props", F.lit(" (end")).alias("response"))
    return events.select("event_id", F.get(t.json_objects(F.col("response"), "struct<k:bigint>"), F.lit(0)).getField("k").alias("k"))


@query("""WITH d AS (SELECT p_partkey, p_name || ' ' || CASE p_size % 5 WHEN 0 THEN p_size || ' gram' WHEN 1 THEN p_size || ',5 - 90 mg' WHEN 2 THEN p_size || 'microgam/ngay' WHEN 3 THEN p_size || ' ml' ELSE p_size || ' MG/ML' END || ' x 1 vien q6h' AS text FROM part),
c AS (SELECT p_partkey, regexp_replace(regexp_replace(text, '(?i)\\bq[0-9]+\\s*h\\b', ' ', 'g'), '(?i)\\bx\\s*[0-9]+\\s*vien\\b', ' ', 'g') AS text FROM d),
e AS (SELECT p_partkey, regexp_extract(text, '(?i)([0-9]+(?:[.,][0-9]+)?)(?:\\s*-\\s*[0-9]+)?\\s*(mg/ml|microgam|gram|mg|ml)(?:[^a-zA-Z]|$)', ['n', 'u']) AS x FROM c), v AS (SELECT p_partkey, CAST(replace(x.n, ',', '.') AS DOUBLE) AS n, lower(x.u) AS u FROM e)
SELECT p_partkey, CASE u WHEN 'ml' THEN NULL WHEN 'gram' THEN n * 1000.0 WHEN 'microgam' THEN n * 0.001 ELSE n END AS value, CASE u WHEN 'ml' THEN NULL WHEN 'mg/ml' THEN 'MG/ML' ELSE 'MG' END AS unit FROM v""")
def number_unit_extract(spark, sf):
    """STR19, STR20, STR27: doses in free text, converted."""
    size = F.col("p_size").cast("string")
    written = F.when(F.col("m") == 0, F.concat(size, F.lit(" gram"))).when(F.col("m") == 1, F.concat(size, F.lit(",5 - 90 mg"))).when(F.col("m") == 2, F.concat(size, F.lit("microgam/ngay"))).when(F.col("m") == 3, F.concat(size, F.lit(" ml"))).otherwise(F.concat(size, F.lit(" MG/ML")))
    parts = table(spark, sf, "part").withColumn("m", F.col("p_size") % 5).select("p_partkey", F.concat("p_name", F.lit(" "), written, F.lit(" x 1 vien q6h")).alias("text"))
    dose = F.get(t.strengths(t.strip_administration(F.col("text"))), F.lit(0))
    return parts.select("p_partkey", dose.getField("value").alias("value"), dose.getField("unit").alias("unit"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(regexp_extract_all(lower(p_name), '[a-z]+[0-9]*'),
  lambda w: CASE WHEN w = 'steel' THEN ['iron', 'alloy'] WHEN w = 'brass' THEN ['copper'] ELSE [w] END)), lambda w: w NOT IN ('large', 'small')))), ' ') AS tokens FROM part""")
def alias_tokens(spark, sf):
    """STR21: name tokens by alias, without stop words."""
    tokens = t.alias_tokens(F.col("p_name"), {"steel": ["iron", "alloy"], "brass": ["copper"]}, ["large", "small"])
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(tokens), " ").alias("tokens"))


@query("""WITH v AS (SELECT c_custkey, unnest([{'text': c_name, 'ord': 1}, {'text': lower(c_name), 'ord': 2}, {'text': lower(strip_accents(c_name)), 'ord': 3}, {'text': array_to_string(list_distinct(regexp_extract_all(lower(c_name), '[a-z]+[0-9]*')), ' '), 'ord': 4}]) AS x FROM customer)
SELECT c_custkey, CAST(count(DISTINCT x.text) AS INT) AS n_views FROM v WHERE length(x.text) >= 2 GROUP BY c_custkey""")
def expand_query(spark, sf):
    """STR22: different views of a query."""
    views = t.expand_query(F.col("c_name"), t.alias_tokens(F.col("c_name"), {}, []))
    return table(spark, sf, "customer").select("c_custkey", F.size(views).alias("n_views"))


@query("""WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ' UNSPECIFIED' WHEN 1 THEN 'Không  rõ ' || c_mktsegment ELSE c_mktsegment END AS x FROM customer),
r AS (SELECT c_custkey, x, trim(regexp_replace(regexp_replace(regexp_replace(x, '(?i)không\\s+rõ', ' ', 'g'), '(?i)unspecified', ' ', 'g'), '\\s+', ' ', 'g')) AS base FROM c)
SELECT c_custkey, CASE WHEN base = '' THEN x ELSE base END AS base, regexp_matches(x, '(?i)không\\s+rõ|unspecified') AS unspecified FROM r""")
def qualifier_strip(spark, sf):
    """STR23: texts without "unspecified" phrases."""
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_mktsegment", F.lit(" UNSPECIFIED"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Không  rõ "), "c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("x"))
    base, found = t.without_qualifiers(F.col("x"))
    return rows.select("c_custkey", base.alias("base"), found.alias("unspecified"))


@query("""WITH c AS (SELECT c_custkey, ['', 'không có ', 'tiền sử ', 'bị '][c_custkey % 4 + 1] || c_mktsegment AS x FROM customer),
n AS (SELECT c_custkey, x, regexp_replace(regexp_replace(x, '(?i)^không\\s+có\\s+', ''), '(?i)^không\\s+', '') AS a, regexp_replace(x, '(?i)^tiền sử\\s+', '') AS b FROM c)
SELECT c_custkey, trim(regexp_replace(CASE WHEN a <> x THEN a ELSE b END, '(?i)^bị\\s+', '')) AS base, CASE WHEN a <> x THEN 'negated' END AS assertion FROM n""")
def assertion_split(spark, sf):
    """STR24: assertion prefixes apart from the text."""
    lead = F.when(F.col("c_custkey") % 4 == 1, "không có ").when(F.col("c_custkey") % 4 == 2, "tiền sử ").when(F.col("c_custkey") % 4 == 3, "bị ").otherwise("")
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(lead, "c_mktsegment").alias("x"))
    base, said = t.split_assertion(F.col("x"), {"negated": [r"không\s+có\s+", r"không\s+"], "historical": [r"tiền sử\s+"]}, [r"bị\s+"])
    return rows.select("c_custkey", base.alias("base"), said.alias("assertion"))


@query("""WITH c AS (SELECT c_custkey, lower(chr(CAST(65 + c_custkey % 26 AS INT)) || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey % 10 AS VARCHAR) END || '†') AS raw FROM customer),
k AS (SELECT c_custkey, regexp_replace(regexp_replace(upper(trim(raw)), '[†*‡]+$', ''), '^([A-Z][0-9]{2})([0-9])$', '\\1.\\2') AS code FROM c)
SELECT c_custkey, code, CASE WHEN regexp_matches(code, '^[A-Z][0-9]{2}$') THEN 'category' WHEN regexp_matches(code, '^[A-Z][0-9]{2}\\.[0-9A-Z]$') THEN 'disease' ELSE 'unknown' END AS level,
  CASE WHEN contains(code, '.') THEN split_part(code, '.', 1) END AS parent, upper(regexp_extract('see ' || lower(code) || ', too', '(?i)\\b([A-Z][0-9]{2}(?:\\.[0-9A-Z])?)\\b', 1)) AS literal FROM k""")
def code_canon(spark, sf):
    """STR25, STR26, SRC11: codes in one spelling, their level and parent."""
    raw = F.concat(F.chr(F.col("c_custkey") % 26 + 65), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise((F.col("c_custkey") % 10).cast("string")), F.lit("†"))
    rows = table(spark, sf, "customer").select("c_custkey", t.canonical_code(F.lower(raw)).alias("code"))
    return rows.select("c_custkey", "code", t.code_level(F.col("code")).alias("level"), t.parent_code(F.col("code")).alias("parent"), t.code_literal(F.concat(F.lit("see "), F.lower("code"), F.lit(", too"))).alias("literal"))


@query("""SELECT lang, CAST(count(*) AS BIGINT) AS n, avg(CAST(regexp_matches(text, '[\\p{Ll}][\\p{Lu}]') AS INT)) AS glue, avg(CAST(regexp_matches(text, '\\*\\*\\*') AS INT)) AS masked, avg(CAST(regexp_matches(text, '[0-9]') AS INT)) AS digits FROM documents GROUP BY lang""")
def text_feature_rates(spark, sf):
    """STR30: shares of texts with glued words, masks and digits, by language."""
    return ev.feature_rates(table(spark, sf, "documents"), "lang", {"glue": t.has_glue_case(F.col("text"), ()), "masked": F.col("text").rlike(r"\*\*\*"), "digits": F.col("text").rlike("[0-9]")})


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, CAST(len(string_split(html, '<p>')) - 1 AS INT) AS paragraphs FROM pages")
def html_title(spark, sf):
    """STR16 on markup: a page's title and number of paragraphs."""
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), (F.size(F.split("html", "<p>", -1)) - 1).alias("paragraphs"))


_SEPARATORS = "chr(32) || chr(9) || chr(13) || '.:;/|-'"


@query(f"""WITH l AS (SELECT doc_id, unnest(range(0, len(s))) AS ord, s FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)), w AS (SELECT doc_id, ord, rtrim(s[ord + 1], chr(13)) AS w, len(s) AS n FROM l)
SELECT doc_id, CAST(ord AS INT) AS ord, CAST(length(w) - length(ltrim(w, {_SEPARATORS})) AS INT) AS head, CASE WHEN trim(w, {_SEPARATORS}) = '' THEN 0 ELSE CAST(length(w) - length(rtrim(w, {_SEPARATORS})) AS INT) END AS tail
FROM w WHERE NOT (ord = n - 1 AND w = '')""")
def separator_trim(spark, sf):
    """FLT10: separators that the borders of every line own."""
    head, tail = t.trim_span(F.col("core"))
    return occ.line_spans(table(spark, sf, "documents")).select("doc_id", "ord", head.alias("head"), tail.alias("tail"))


@query()
def segment_words(spark, sf):
    """STR28, STR29: phrases joined to words, and every joined word back to its raw place; tested against a plain loop."""
    docs = table(spark, sf, "documents")
    cut = gen.segmented(docs, ["of the", "in the", "de la", "to be"])
    return cut.select("doc_id", F.md5("segmented").alias("segmented_md5"), F.size("seg2raw").alias("n"), gen.raw_places(F.col("seg2raw"), F.lit(0), F.size("seg2raw")).alias("all")).select("doc_id", "segmented_md5", "n", "all.start", "all.end")
