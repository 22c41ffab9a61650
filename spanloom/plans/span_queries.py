"""Queries over intervals, each with the SQL that checks it: events as spans of hours per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import intervals as iv
from spanloom.operators import validate

from .tables import registry, table

QUERIES, ORACLES, query = registry()


def spans(spark, sf):
    """Events as spans: hours since the first of January, 1 to 4 long."""
    hours = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("int")
    events = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), hours.alias("start"), "event_type", "value")
    return events.select(
        "doc_id", "ord", "start", (F.col("start") + (F.col("ord") % 4 + 1).cast("int")).alias("end"), F.col("event_type").alias("type"), F.concat(F.lit("t"), F.pmod(F.col("ord"), F.lit(6)).cast("string")).alias("text"), "value",
        F.array(F.concat(F.lit("f"), (F.col("ord") % 3).cast("string"))).alias("assertions"),
        F.when(F.col("ord") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("ord") % 7).cast("string"))).alias("candidates"),
    )


_S = """s AS (SELECT user_id AS doc_id, event_id AS ord, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS INT) AS start,
  CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) + event_id % 4 + 1 AS INT) AS "end", event_type AS type, 't' || CAST(event_id % 6 AS VARCHAR) AS text, value FROM events)"""


@query(f"""WITH {_S} SELECT doc_id, start, "end", type, array_to_string(list_sort(list_distinct(list('f' || CAST(ord % 3 AS VARCHAR)))), ',') AS flags,
coalesce(CAST(arg_min(ord % 7, ord) FILTER (WHERE ord % 2 = 1) AS VARCHAR), '') AS candidates, min(ord) AS ord FROM s GROUP BY doc_id, start, "end", type""")
def span_dedup(spark, sf):
    """INT1: exact duplicates united."""
    out = iv.dedup_exact(spans(spark, sf))
    return out.select("doc_id", "start", "end", "type", F.array_join("assertions", ",").alias("flags"), F.array_join("candidates", ",").alias("candidates"), "ord")


@query(f"""WITH {_S} SELECT doc_id, ord, start, "end", type FROM s a WHERE NOT EXISTS (SELECT 1 FROM s k WHERE k.doc_id = a.doc_id AND k.start <= a.start AND k."end" >= a."end" AND k."end" - k.start > a."end" - a.start)""")
def drop_nested(spark, sf):
    """INT3: spans inside longer ones go."""
    return iv.drop_nested(spans(spark, sf)).select("doc_id", "ord", "start", "end", "type")


PRIORITY = ["purchase", "error", "signup", "click", "view"]


@query(f"""WITH {_S} SELECT doc_id, start, "end", ord, type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY list_position({PRIORITY}, type), ord) AS r FROM s) WHERE r = 1""")
def same_span_priority(spark, sf):
    """INT4: one type per place."""
    return iv.same_span_priority(spans(spark, sf).select("doc_id", "start", "end", "ord", "type"), PRIORITY)


@query(f"""WITH {_S}, v AS (SELECT doc_id, text, type, count(*) AS n, min(CAST(start AS BIGINT) * 100000000 + ord) AS pos0 FROM s GROUP BY doc_id, text, type),
w AS (SELECT * FROM (SELECT doc_id, text, type AS won, row_number() OVER (PARTITION BY doc_id, text ORDER BY n DESC, CASE type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 ELSE 99 END, pos0) AS r FROM v) WHERE r = 1)
SELECT s.doc_id, ord, s.text, won AS type FROM s JOIN w ON s.doc_id = w.doc_id AND s.text = w.text""")
def harmonize_majority(spark, sf):
    """INT5: equal texts of a document get one type."""
    return iv.harmonize_types(spans(spark, sf).select("doc_id", "ord", "start", "text", "type"), ["purchase", "error"]).select("doc_id", "ord", "text", "type")


@query(f"""WITH {_S}, a AS (SELECT *, lag("end") OVER w AS pe, lag(type) OVER w AS pt FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY start, "end", ord)),
b AS (SELECT *, sum(CASE WHEN type = 'view' AND pt = 'view' AND start - pe BETWEEN 1 AND 30 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, "end", ord) AS island FROM a)
SELECT doc_id, min(type) AS type, min(start) AS start, arg_max("end", CAST(start AS BIGINT) * 1000000000000 + CAST("end" AS BIGINT) * 100000000 + ord) AS "end", count(*) AS parts FROM b GROUP BY doc_id, island""")
def gap_merge(spark, sf):
    """INT7: neighbours of one type with small gaps between become one."""
    return iv.gap_merge(spans(spark, sf), "view")


@query(f"""WITH {_S} SELECT a.doc_id, a.ord AS "left", b.ord AS "right", CAST(a."end" - b.start AS INT) AS amount FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.start < b.start AND b.start < a."end" AND a."end" < b."end" """)
def overlap_pairs(spark, sf):
    """INT10, INT11: spans that cross."""
    return iv.partial_overlaps(spans(spark, sf))


@query(f"""WITH {_S} SELECT doc_id, ord, start, "end" FROM (SELECT *, lag("end") OVER (PARTITION BY doc_id ORDER BY start, "end", ord) AS pe FROM s) WHERE pe > start""")
def adjacent_overlap(spark, sf):
    """INT19: spans that begin before their neighbour ends."""
    return iv.adjacent_overlaps(spans(spark, sf)).select("doc_id", "ord", "start", "end")


@query(f"""WITH {_S}, p AS (SELECT doc_id, ord, start AS pos FROM s WHERE type <> 'signup'), z AS (SELECT doc_id, start, max('c' || CAST(ord % 9 AS VARCHAR)) AS category FROM s WHERE type = 'signup' GROUP BY doc_id, start)
SELECT p.doc_id, p.ord, p.pos, z.category FROM p ASOF LEFT JOIN z ON p.doc_id = z.doc_id AND p.pos >= z.start""")
def point_in_interval(spark, sf):
    """INT16, CTX lookups: the section that a point lies in."""
    s = spans(spark, sf)
    points = s.where("type != 'signup'").select("doc_id", F.col("start").alias("pos"), "ord")
    sections = s.where("type = 'signup'").groupBy("doc_id", "start").agg(F.max(F.concat(F.lit("c"), (F.col("ord") % 9).cast("string"))).alias("category"))
    return iv.section_at(points, sections).select("doc_id", "ord", "pos", "category")


@query(f"""WITH {_S}, g AS (SELECT doc_id, start AS s0, start + 72 AS e0, ord AS segment FROM s WHERE type = 'signup') SELECT g.doc_id, segment, ord, CAST(start - s0 AS INT) AS local_start, CAST("end" - s0 AS INT) AS local_end FROM g JOIN s ON g.doc_id = s.doc_id AND start >= s0 AND "end" <= e0 AND type <> 'signup'""")
def containment_local(spark, sf):
    """INT17: spans inside a segment, counted from its start."""
    s = spans(spark, sf)
    g = s.where("type = 'signup'").select("doc_id", F.col("start").alias("s0"), (F.col("start") + 72).alias("e0"), F.col("ord").alias("segment"))
    return iv.contained(g, s.where("type != 'signup'")).select("doc_id", "segment", "ord", "local_start", "local_end")


@query("""SELECT c_custkey, unnest(CASE WHEN c_acctbal >= 0 THEN ['name', 'value'] ELSE ['value'] END) AS part, unnest(CASE WHEN c_acctbal >= 0 THEN [c_mktsegment, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR)] ELSE [c_mktsegment || ' là ' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR)] END) AS text FROM customer""")
def name_value_split(spark, sf):
    """INT8: names apart from values."""
    rows = table(spark, sf, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit(" là "), F.floor("c_acctbal").cast("string")).alias("x"))
    return rows.select("c_custkey", F.inline(iv.split_name_value(F.col("x"))))


@query("SELECT p_partkey, p_name AS text FROM part")
def span_trims(spark, sf):
    """INT9: punctuation, connectives and what follows an indication go."""
    tail = F.when(F.col("p_partkey") % 3 == 0, " và: ,").when(F.col("p_partkey") % 3 == 1, ".").otherwise(" cho x do y")
    rows = table(spark, sf, "part").select("p_partkey", F.concat("p_name", tail).alias("x"))
    return rows.select("p_partkey", iv.strip_tail(iv.cut_at(F.col("x"), [" cho ", " do ", " vì "]), [" và", " hoặc", " của", " là", " thì", " mà"]).alias("text"))


@query(f"""WITH {_S}, v AS (SELECT ord, start < 0 OR "end" <= start AS bad_bounds, type NOT IN ('view', 'click', 'purchase', 'signup') AS bad_type, "end" > 740 AS past_end, count(*) OVER (PARTITION BY doc_id, start, "end", type) > 1 AS duplicate FROM s)
SELECT code, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(['bad_bounds', 'bad_type', 'duplicate_exact', 'past_end']) AS code, unnest([CAST(bad_bounds AS INT), CAST(bad_type AS INT), CAST(duplicate AS INT), CAST(past_end AS INT)]) AS n FROM v) GROUP BY code""")
def validate_counts(spark, sf):
    """FLT1, FLT2, FLT3: how many spans break which rule."""
    s = spans(spark, sf)
    return validate.violation_counts(s, {"bad_bounds": "start < 0 or end <= start", "bad_type": "type not in ('view', 'click', 'purchase', 'signup')", "past_end": "end > 740"}, ["doc_id", "start", "end", "type"])


@query(f"""WITH {_S}, v AS (SELECT doc_id, ord, concat_ws(',', CASE WHEN "end" > 700 THEN 'invalid_position' END, CASE WHEN type = 'error' THEN 'invalid_type' END) AS errors FROM s) SELECT doc_id, ord, errors FROM v WHERE errors <> '' ORDER BY doc_id, ord LIMIT 20""")
def first_errors(spark, sf):
    """FLT3: the first twenty rows that break a rule (a report)."""
    broken = F.array_compact(F.array(F.when(F.col("end") > 700, "invalid_position"), F.when(F.col("type") == "error", "invalid_type")))
    return validate.first_errors(spans(spark, sf), broken, ["doc_id", "ord"]).select("doc_id", "ord", F.array_join("errors", ",").alias("errors"))


@query(f"""WITH {_S} SELECT doc_id, ord, type, value FROM s WHERE (CASE type WHEN 'view' THEN value WHEN 'click' THEN value / 2 WHEN 'purchase' THEN 1000 ELSE value END) >= CASE type WHEN 'view' THEN 40 WHEN 'click' THEN 10 WHEN 'purchase' THEN 5 ELSE -1e9 END""")
def confidence_guard(spark, sf):
    """FLT6, CTX12: each type's own measure against its own threshold; unknown types stay."""
    rules = spark.createDataFrame([("view", "full", 40.0), ("click", "half", 10.0), ("purchase", "fixed", 5.0)], "type string, metric string, threshold double")
    s = spans(spark, sf).withColumn("metrics", F.create_map(F.lit("full"), F.col("value"), F.lit("half"), F.col("value") / 2, F.lit("fixed"), F.lit(1000.0)))
    return validate.above_threshold(s, rules).select("doc_id", "ord", "type", "value")


@query(f"""WITH {_S} SELECT doc_id, CAST(len(l) AS INT) AS n, md5('[' || array_to_string(l, ',') || ']') AS json_md5 FROM (SELECT doc_id, list('{{"text":"' || text || '","position":[' || start || ',' || "end" || '],"type":"' || type || '"}}' ORDER BY ord) AS l FROM s GROUP BY doc_id)""")
def json_sink_rows(spark, sf):
    """SNK1: one JSON array per document, in order."""
    return validate.json_rows(spans(spark, sf)).select("doc_id", "n", F.md5("json").alias("json_md5"))


@query()
def collapse_overlap(spark, sf):
    """INT2: greedy, so tested against a plain loop."""
    return iv.collapse_overlapping(spans(spark, sf).select("doc_id", "ord", "start", "end", "type"))


@query()
def greedy_fill(spark, sf):
    """INT6: greedy, so tested against a plain loop."""
    return iv.greedy_fill(spans(spark, sf).select("doc_id", "ord", "start", "end", "type"))


@query()
def resolve_by_score(spark, sf):
    """INT15: greedy, so tested against a plain loop."""
    return iv.resolve_by_score(spans(spark, sf).select("doc_id", "ord", "start", "end", "type", F.col("value").alias("score")))
