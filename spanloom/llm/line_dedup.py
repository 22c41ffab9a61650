"""Overlapping three-line windows: windows repeated anywhere lose all but their first occurrence.

DataFrame functions only. Every ``window`` consecutive lines are hashed; the first occurrence of a
hash is the smallest (doc_id, position), found by a grouped minimum with map-side partial sums, so a
window that very many documents share is one row per task in the shuffle. Only windows seen twice
are joined back, the commonest of them salted. The positions that later occurrences cover are merged per document and removed.

Defined results: ids may be of any type that can be ordered; null ``doc_id`` sorts last; a null text stays null with 0 lines; documents with
fewer lines than a window stay whole. Rows that repeat both id and text are one document, and each
gets its result. In a run of equal lines only the first stays, as each window but the first is a
later occurrence. A document whose lines all go stays with an empty text. An empty table gives no
rows. Lines are compared exactly and end at line feeds. Extra columns are kept by :func:`without_repeats`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, columns_of, free_name
from .runs import join_groups

_KEY = ("unnumbered", "doc", "t1", "t2")


def _keyed(doc_id: Column, text: Column) -> list[Column]:
    """What tells documents apart, in the order of the ids: whether there is none, the id, and two hashes of the text."""
    text = F.coalesce(text, F.lit(""))
    return [doc_id.isNull().alias("unnumbered"), doc_id.alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def windows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    """``unnumbered, doc, t1, t2, pos, a, b``: each window's place and its two hashes."""
    rows = columns_of(df, id=doc_id, text=text).where(F.col("text").isNotNull())
    rows = rows.select(*_keyed(F.col("id"), F.col("text")), F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= window)

    def hashed(i: Column) -> Column:
        lines = [F.get("lines", i + k) for k in range(window)]
        return F.struct(i.alias("pos"), F.xxhash64(*lines).alias("a"), F.xxhash64(F.lit(1), *lines).alias("b"))

    each = F.transform(F.sequence(F.lit(0), F.size("lines") - window), hashed)
    return rows.select(*_KEY, F.explode(each).alias("w")).select(*_KEY, "w.pos", "w.a", "w.b")


def later_windows(found: DataFrame) -> DataFrame:
    """``unnumbered, doc, t1, t2, starts``: per document, where windows begin that occurred before."""
    place = F.struct(*_KEY, "pos")
    repeated = found.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("members"))
    repeated = repeated.where("first != last").select("a", "b", "first", "members")
    later = join_groups(found, Scratch(found.sparkSession, "windows").keep(repeated), ["a", "b"], F.col("t1")).where(place != F.col("first"))
    return later.groupBy(*_KEY).agg(F.collect_set("pos").alias("starts"))


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    """``df`` with the lines left in ``text``; two more columns ``n_lines`` and ``n_removed`` under free names."""
    total, removed = free_name(df, "n_lines"), free_name(df, "n_removed")
    body, id_ = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    starts = later_windows(windows(df, doc_id, text, window))
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *_keyed(id_, body))
    later = starts.select("starts", *[F.col(k).alias(f"of_{k}") for k in _KEY])
    joined = whole.join(later, [F.col(k).eqNullSafe(F.col(f"of_{k}")) if k == "doc" else F.col(k) == F.col(f"of_{k}") for k in _KEY], "left")
    lines = F.split(F.col("row").getField(text), "\n", -1)
    covered = F.flatten(F.transform("starts", lambda s: F.array(*[s + k for k in range(window)])))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered), lambda i: F.get(lines, i))
    joined = joined.select("row", F.coalesce(F.size(lines), F.lit(0)).alias("n"), F.when(F.col("starts").isNotNull(), left).alias("left"))
    kept = F.when(F.col("left").isNull(), F.col("row").getField(text)).otherwise(F.array_join("left", "\n"))
    return joined.select(
        *[kept.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns],
        F.greatest("n", F.lit(0)).alias(total),
        F.when(F.col("left").isNull(), 0).otherwise(F.col("n") - F.size("left")).alias(removed),
    )


SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, pos, l[pos] || chr(10) || l[pos + 1] || chr(10) || l[pos + 2] AS k
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS pos FROM d)
),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM w),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE nth > 1),
e AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS pos FROM d),
k AS (
  SELECT e.doc_id, string_agg(l[e.pos], chr(10) ORDER BY e.pos) AS t, count(*) AS n
  FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.pos = c.pos
  WHERE c.pos IS NULL GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(len(l) AS INT) AS n_lines, CAST(len(l) - coalesce(n, 0) AS INT) AS n_removed, coalesce(t, '') AS text
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
