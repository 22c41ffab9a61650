"""Linking queries: parts are the catalogue, suppliers ask for part names with a size."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as t
from spanloom.operators import linking as ln

from .tables import registry, table

QUERIES, ORACLES, query = registry()


def entries(spark, sf):
    kind = F.substring_index("p_type", " ", 1)
    prio = F.when(kind == "ECONOMY", 0).when(kind == "STANDARD", 1).when(kind == "PROMO", 2).otherwise(3)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_brand").alias("concept"), F.lower("p_name").alias("name"), F.split(F.lower("p_name"), " ").alias("tokens"), F.col("p_size").cast("double").alias("value"), prio.alias("prio"), (F.col("p_size") > 45).alias("suppressed"))


def asked(spark, sf):
    """Every supplier asks for one part; together they ask for parts of the whole catalogue."""
    p = table(spark, sf, "part").select((F.col("p_partkey")).alias("k"), F.lower("p_name").alias("text"))
    n = p.agg(F.count("*").alias("n"))
    s = table(spark, sf, "supplier").crossJoin(n).select(F.col("s_suppkey").alias("qid"), (F.pmod(F.col("s_suppkey") * 7, "n") + 1).alias("k"))  # n is one row
    return s.join(p, "k").select("qid", "text", F.split("text", " ").alias("tokens"), (F.col("qid") % 50 + 1).cast("double").alias("value"))


_E = """e AS (SELECT p_partkey AS entry_id, p_brand AS concept, lower(p_name) AS name, string_split(lower(p_name), ' ') AS tokens, CAST(p_size AS DOUBLE) AS value,
  CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 WHEN 'PROMO' THEN 2 ELSE 3 END AS prio, p_size > 45 AS suppressed FROM part),
q AS (SELECT s_suppkey AS qid, lower(p_name) AS text, string_split(lower(p_name), ' ') AS tokens, CAST(s_suppkey % 50 + 1 AS DOUBLE) AS value FROM supplier JOIN part ON p_partkey = (s_suppkey * 7) % (SELECT count(*) FROM part) + 1)"""
_SC = _E + """,
b AS (SELECT qid, entry_id, count(*) AS shared FROM (SELECT qid, unnest(list_distinct(tokens)) AS token FROM q) a JOIN (SELECT entry_id, unnest(list_distinct(tokens)) AS token FROM e) i ON a.token = i.token GROUP BY qid, entry_id),
sc AS (SELECT b.qid, b.entry_id, e.concept, e.value, e.prio, q.value AS asked,
  0.5 * greatest(shared / CAST(len(q.tokens) AS DOUBLE) - 0.4 * (len(e.tokens) - shared), 0.0) + 0.5 * CASE WHEN q.value = e.value THEN 1.0 ELSE 0.6 / (1 + abs(q.value - e.value)) END
  + (20 - e.prio) * 0.001 - CASE WHEN e.suppressed THEN 0.2 ELSE 0 END AS score FROM b JOIN q ON b.qid = q.qid JOIN e ON b.entry_id = e.entry_id)"""
_RK = _SC + """,
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, concept ORDER BY round(score, 12) DESC, prio, entry_id) AS r FROM sc) WHERE r = 1),
rk AS (SELECT qid, concept, entry_id, value, prio, asked, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, prio, entry_id) AS rank FROM c)"""


def ranked(spark, sf):
    """Each query's concepts in order; what is asked several times is looked up once, entries that can't be told apart stand once."""
    few = ln.distinct_entries(entries(spark, sf))
    return ln.once(asked(spark, sf), lambda q: ln.rank_concepts(ln.score(q, few).withColumn("score", F.round("score", 12))))


@query(f"WITH {_E} SELECT token, CAST(count(*) AS BIGINT) AS n, min(entry_id) AS first_entry FROM (SELECT entry_id, unnest(list_distinct(tokens)) AS token FROM e) GROUP BY token")
def token_index(spark, sf):
    """LNK1, SRC8: postings by token."""
    return ln.token_index(entries(spark, sf)).groupBy("token").agg(F.count("*").alias("n"), F.min("entry_id").alias("first_entry"))


@query(f"WITH {_SC} SELECT qid, entry_id, round(score, 9) AS score FROM sc")
def containment_score(spark, sf):
    """LNK1, LNK2, LNK3: blocked pairs and their scores."""
    return ln.pair_scores(asked(spark, sf), entries(spark, sf), lambda s: F.round(F.round(s, 12), 9))


@query(f"WITH {_RK} SELECT qid, concept, entry_id, CAST(rank AS INT) AS rank FROM rk")
def rank_concepts(spark, sf):
    """LNK4: each query's concepts in order."""
    return ranked(spark, sf).select("qid", "concept", "entry_id", "rank")


@query(f"WITH {_RK}, m AS (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM rk) SELECT qid, concept, CAST(rank AS INT) AS rank FROM m WHERE rank <= CASE WHEN round(top, 12) >= 0.75 THEN 1 ELSE 3 END")
def collapse_topk(spark, sf):
    """LNK5: one sure concept or the first three."""
    return ln.collapse_or_top(ranked(spark, sf)).select("qid", "concept", "rank")


@query(f"WITH {_SC} SELECT qid, entry_id, value FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY abs(value - asked), value, prio, entry_id) AS r FROM sc) WHERE r = 1")
def nearest_value(spark, sf):
    """LNK6: the nearest size among blocked entries."""
    return ln.nearest_blocked(asked(spark, sf), entries(spark, sf)).select("qid", "entry_id", "value")


_X = """x AS (SELECT qid, entry_id FROM (SELECT q.qid, e.entry_id, prio, min(prio) OVER (PARTITION BY qid) AS best FROM q JOIN e ON list_sort(list_distinct(q.tokens)) = list_sort(list_distinct(e.tokens)) AND q.value = e.value) WHERE prio = best)"""


@query(f"WITH {_E}, {_X} SELECT * FROM x")
def exact_link(spark, sf):
    """LNK8: equal tokens and size."""
    return ln.exact_link(asked(spark, sf), entries(spark, sf))


@query(f"""WITH {_RK}, {_X}, m AS (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM rk)
SELECT qid, entry_id, 1 AS tier FROM x UNION ALL SELECT qid, entry_id, 2 AS tier FROM m WHERE rank <= CASE WHEN round(top, 12) >= 0.75 THEN 1 ELSE 3 END AND qid NOT IN (SELECT qid FROM x)""")
def tier_cascade(spark, sf):
    """LNK7, its plainest form: exact links, and ranked ones for the queries that they leave."""
    queries, catalogue = asked(spark, sf), entries(spark, sf)
    exact = ln.exact_link(queries, catalogue)
    left = queries.join(exact.select("qid").distinct(), "qid", "left_anti")
    few = ln.distinct_entries(catalogue)
    found = ln.once(left, lambda q: ln.collapse_or_top(ln.rank_concepts(ln.score(q, few).withColumn("score", F.round("score", 12)))))
    return ln.first_tier(exact, found.select("qid", "entry_id"))


_KINDS = _E + """,
c0 AS (SELECT entry_id, concept, tokens, prio, suppressed, CASE WHEN entry_id % 3 = 0 THEN NULL ELSE value END AS value, entry_id % 3 = 0 AS bare FROM e),
q0 AS (SELECT qid, CASE WHEN qid % 17 = 0 THEN ['antibiotics'] WHEN qid % 13 = 0 THEN CAST([] AS VARCHAR[]) ELSE tokens END AS tokens, CASE WHEN qid % 5 = 0 THEN NULL WHEN qid % 7 = 0 THEN value + 0.25 ELSE value END AS value FROM q),
dn AS (SELECT qid, 1 AS rank, qid % 3 + 1 AS entry_id, 'dense' AS concept FROM q0),
q1 AS (SELECT * FROM q0 WHERE tokens <> ['antibiotics']),
s0 AS (SELECT qid, entry_id, concept, c0.value, prio, suppressed, bare, q1.value AS asked, round(CASE WHEN q1.value IS NULL THEN lex ELSE 0.5 * lex + 0.5 * CASE WHEN c0.value IS NULL THEN 0.0 WHEN c0.value = q1.value THEN 1.0 ELSE 0.6 / (1 + abs(q1.value - c0.value)) END END + (20 - prio) * 0.001 - CASE WHEN suppressed THEN 0.2 ELSE 0 END, 12) AS score
  FROM q1 JOIN c0 ON len(list_intersect(q1.tokens, c0.tokens)) > 0, LATERAL (SELECT greatest(len(list_intersect(q1.tokens, c0.tokens)) / CAST(len(list_distinct(q1.tokens)) AS DOUBLE) - 0.4 * (len(list_distinct(c0.tokens)) - len(list_intersect(q1.tokens, c0.tokens))), 0.0) AS lex) t),
b0 AS (SELECT qid, concept, bare, arg_min({'entry_id': entry_id, 'prio': prio, 'score': score}, ROW(-score, prio, entry_id)) AS b, max(coalesce(value = asked, false)) AS same, max(asked IS NOT NULL) AS valued,
  arg_min({'entry_id': entry_id, 'far': abs(value - asked)}, ROW(abs(value - asked), value, suppressed, prio, entry_id)) FILTER (WHERE value IS NOT NULL AND asked IS NOT NULL) AS near, min(ROW(abs(value - asked), value, suppressed, prio, entry_id)) FILTER (WHERE value IS NOT NULL AND asked IS NOT NULL) AS nearkey FROM s0 GROUP BY qid, concept, bare),
b1 AS (SELECT *, max(same) OVER (PARTITION BY qid, bare) AS any_same FROM b0),
b2 AS (SELECT *, row_number() OVER (PARTITION BY qid, bare ORDER BY b.score DESC, b.prio, b.entry_id) AS rank, max(b.score) OVER (PARTITION BY qid, bare) AS top, min(nearkey) OVER (PARTITION BY qid, bare) AS nearest FROM b1 WHERE b.score >= 0.35 AND (bare OR valued)),
b3 AS (SELECT *, CASE WHEN NOT bare AND (any_same OR nearest IS NULL) AND rank <= CASE WHEN top >= 0.75 THEN 1 ELSE 3 END THEN 'dosed' WHEN NOT bare AND NOT (any_same OR nearest IS NULL) AND nearkey = nearest THEN 'nearest' WHEN bare AND rank <= CASE WHEN top >= 0.75 THEN 1 ELSE 3 END THEN 'bare' END AS tier FROM b2),
b4 AS (SELECT *, min(CASE tier WHEN 'bare' THEN 2 ELSE 1 END) OVER (PARTITION BY qid) AS first FROM b3 WHERE tier IS NOT NULL),
b5 AS (SELECT qid, CASE WHEN tier = 'nearest' THEN 1 ELSE rank END AS rank, CASE WHEN tier = 'nearest' THEN near.entry_id ELSE b.entry_id END AS entry_id, concept, tier FROM b4 WHERE CASE tier WHEN 'bare' THEN 2 ELSE 1 END = first)"""


@query(f"WITH {_KINDS} SELECT qid, CAST(rank AS INT) AS rank, entry_id, concept, tier FROM b5 UNION ALL SELECT qid, rank, entry_id, concept, 'dense' FROM dn WHERE qid IN (SELECT qid FROM q1) AND qid NOT IN (SELECT qid FROM b5)")
def link_cascade(spark, sf):
    """LNK7: class terms, dosed, nearest, bare and dense tiers."""
    bare = F.col("entry_id") % 3 == 0
    catalogue = entries(spark, sf).withColumn("bare", bare).withColumn("value", F.when(~F.col("bare"), F.col("value")))
    q = asked(spark, sf)
    q = q.select("qid", F.when(F.col("qid") % 17 == 0, F.array(F.lit("antibiotics"))).when(F.col("qid") % 13 == 0, F.array().cast("array<string>")).otherwise(F.col("tokens")).alias("tokens"), F.when(F.col("qid") % 5 == 0, None).when(F.col("qid") % 7 == 0, F.col("value") + 0.25).otherwise(F.col("value")).alias("value"))
    dense = q.select("qid", F.lit(1).alias("rank"), (F.col("qid") % 3 + 1).alias("entry_id"), F.lit("dense").alias("concept"))
    return ln.cascade(q, catalogue, ["antibiotics"], dense)


@query(f"WITH {_RK}, n AS (SELECT *, lead(score) OVER (PARTITION BY qid ORDER BY rank) AS nx FROM rk) SELECT qid, concept FROM n WHERE rank = 1 AND score >= 0.35 AND (nx IS NULL OR round(round(score, 12) - round(nx, 12), 11) >= 0.01)")
def conservative_select(spark, sf):
    """LNK9: only clear winners."""
    r = ranked(spark, sf)
    return ln.conservative(r, margin=0.01 - 1e-11).select("qid", "concept")


@query(f"""WITH {_E}, qq AS (SELECT qid, CASE WHEN qid % 4 = 0 THEN text || ' zz' ELSE text END AS text, CASE WHEN qid % 4 = 0 THEN list_append(tokens, 'zz') ELSE tokens END AS tokens FROM q),
z AS (SELECT q.qid, e.concept, e.entry_id, CASE WHEN q.text = e.name THEN 100.0 WHEN starts_with(e.name, q.text) THEN 88.0 WHEN contains(e.name, q.text) THEN 78.0 ELSE 50 + 25 * (len(list_intersect(q.tokens, e.tokens)) / CAST(len(list_distinct(q.tokens)) AS DOUBLE)) END - CASE WHEN suppressed THEN 15.0 ELSE 0 END - 0.01 * prio AS score,
  len(list_intersect(q.tokens, e.tokens)) = len(list_distinct(q.tokens)) AS whole FROM qq q JOIN e ON len(list_intersect(q.tokens, e.tokens)) > 0), y AS (SELECT *, bool_or(whole) OVER (PARTITION BY qid) AS any_whole FROM z),
b AS (SELECT qid, concept, round(max(score), 6) AS score FROM y WHERE whole OR NOT any_whole GROUP BY qid, concept)
SELECT qid, concept, score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, concept) AS r FROM b) WHERE r <= 20""")
def catalog_search(spark, sf):
    """LNK12: a catalogue search among entries with all words, else with any; the twenty best concepts (a top-k report)."""
    from pyspark.sql import Window as W

    e, q = entries(spark, sf), asked(spark, sf)
    odd = F.col("qid") % 4 == 0
    q = q.select("qid", F.when(odd, F.concat("text", F.lit(" zz"))).otherwise(F.col("text")).alias("text"), F.when(odd, F.array_append("tokens", F.lit("zz"))).otherwise(F.col("tokens")).alias("tokens"))
    # names and texts that repeat are compared once; an entry only adds its priority and whether it is suppressed
    one = e.groupBy("name", "concept", "suppressed").agg(F.min("prio").alias("prio"), F.first("tokens").alias("tokens"))

    def work(queries):
        pairs = ln.whole_or_any(ln.keyed_pairs(queries, one))
        given = one.withColumn("ek", ln.token_key(F.col("tokens")))
        rows = queries.withColumn("qk", ln.token_key(F.col("tokens"))).select("qid", "text", "qk").join(pairs, "qk").join(given.drop("tokens"), "ek")
        score = ln.catalogue_score(F.col("text"), F.col("concept"), F.col("name"), F.col("qt"), F.col("et"), F.col("suppressed"), F.col("prio"))
        return rows.groupBy("qid", "concept").agg(F.round(F.max(score), 6).alias("score"))

    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "concept"))
    return ln.once(q, work, "text").withColumn("rank", rank).where("rank <= 20")


@query(f"WITH {_E}, u AS (SELECT concept, name, min(prio * 100000000 + entry_id) AS k FROM e GROUP BY concept, name) SELECT concept, CAST(r AS INT) AS ord, name FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY k) AS r FROM u) WHERE r <= 20")
def views_corpus(spark, sf):
    """LNK13: a concept's names in order."""
    return ln.views(entries(spark, sf))


@query(f"WITH {_E} SELECT concept, prio, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY prio, entry_id) AS r FROM e) WHERE r = 1")
def representatives(spark, sf):
    """LNK36: one entry per concept."""
    return ln.representatives(entries(spark, sf))


@query("""WITH n AS (SELECT n_nationkey, n_regionkey AS code, trim(regexp_replace(regexp_replace(lower(n_name), '[_\\-]+', ' ', 'g'), '\\s+', ' ', 'g')) || ' á' AS cons FROM nation), k AS (SELECT code, cons, strip_accents(cons) AS aggr, n_nationkey FROM n),
c AS (SELECT c_custkey AS qid, trim(regexp_replace(regexp_replace(lower(n_name || CASE WHEN c_custkey % 2 = 0 THEN ' Á' ELSE ' A' END), '[_\\-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS cons FROM customer JOIN nation ON c_nationkey = n_nationkey),
a AS (SELECT cons, arg_min(code, n_nationkey) AS code FROM k GROUP BY cons), b AS (SELECT aggr, arg_min(code, n_nationkey) AS code FROM k GROUP BY aggr)
SELECT qid, coalesce(a.code, b.code) AS code, CASE WHEN a.code IS NOT NULL THEN 'conservative' WHEN b.code IS NOT NULL THEN 'aggressive' END AS how FROM c LEFT JOIN a ON c.cons = a.cons LEFT JOIN b ON strip_accents(c.cons) = b.aggr""")
def alias_lookup(spark, sf):
    """LNK20, LNK33: names by their two keys, each different text once."""
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("code"), F.col("n_nationkey").alias("ord"), F.concat(t.normalize_conservative(F.col("n_name")), F.lit(" á")).alias("cons"))
    names = n.withColumn("aggr", t.normalize_aggressive(F.col("cons")))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.col("c_custkey").alias("qid"), F.concat("n_name", F.when(F.col("c_custkey") % 2 == 0, " Á").otherwise(" A")).alias("x"))
    texts = c.select("x").distinct().withColumn("cons", t.normalize_conservative(F.col("x"))).withColumn("aggr", t.normalize_aggressive(F.col("x")))
    found = ln.lookup(texts.withColumnRenamed("x", "qid"), names).withColumnRenamed("qid", "x")
    return c.join(found, "x").select("qid", "code", "how")


@query("""WITH k AS (SELECT r_regionkey AS code, min(CASE WHEN contains(n_name, 'IA') THEN n_nationkey END) AS named, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey)
SELECT s_suppkey AS qid, CASE WHEN s_suppkey % 2 = 0 AND named IS NOT NULL THEN 'R' || n_regionkey || '.' || named ELSE 'R' || n_regionkey END AS code, CASE WHEN s_suppkey % 2 = 0 AND named IS NOT NULL THEN 0.95 ELSE 0.75 END AS confidence
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN k ON k.code = n_regionkey""")
def qualifier_backoff(spark, sf):
    """LNK21: an unspecified request goes to the fitting child."""
    nation = table(spark, sf, "nation")
    region = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))
    # children sort as their numbers do
    kids = nation.select(region.alias("code"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("child"), F.col("n_name").alias("name"))
    base = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("qid"), region.alias("code"), (F.col("s_suppkey") % 2 == 0).alias("unspecified"))
    out = ln.qualifier_backoff(base, kids, "IA").join(base.select("qid", F.col("code").alias("base")), "qid")
    return out.select("qid", F.when(F.col("code") == F.col("base"), F.col("base")).otherwise(F.concat("base", F.lit("."), F.col("code").cast("int").cast("string"))).alias("code"), "confidence")


@query("""SELECT n_nationkey AS code, n_regionkey AS parent, CAST(0 AS BIGINT) AS n_children, count(*) OVER (PARTITION BY n_regionkey) - 1 AS n_siblings FROM nation""")
def hierarchy_family(spark, sf):
    """LNK28: parents, children and siblings."""
    return ln.family(table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))).select(F.col("code").cast("int").alias("code"), F.substring("parent", 2, 9).cast("int").alias("parent"), F.col("n_children").cast("long").alias("n_children"), F.col("n_siblings").cast("long").alias("n_siblings"))


@query("SELECT n_nationkey AS code, concat('Code ', n_nationkey, '. Name ', n_name, '. Group ', r_name) AS doc FROM nation JOIN region ON n_regionkey = r_regionkey")
def enriched_text(spark, sf):
    """LNK29: a node's text with its parent's name."""
    j = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select(F.col("n_nationkey").alias("code"), F.concat_ws(". ", F.concat(F.lit("Code "), F.col("n_nationkey").cast("string")), F.concat(F.lit("Name "), "n_name"), F.concat(F.lit("Group "), "r_name")).alias("doc"))


@query("SELECT DISTINCT c_mktsegment AS alias, 'segment' AS source, 1.0 AS confidence FROM customer UNION ALL SELECT DISTINCT o_orderpriority, 'priority', 0.9 FROM orders WHERE o_orderpriority NOT IN (SELECT c_mktsegment FROM customer)")
def alias_merge(spark, sf):
    """LNK32: new aliases where there were none."""
    have = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("alias"), F.lit("segment").alias("source"), F.lit(1.0).alias("confidence")).distinct()
    new = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("alias")).distinct().join(have, "alias", "left_anti")
    return have.unionByName(new.select("alias", F.lit("priority").alias("source"), F.lit(0.9).alias("confidence")))


@query(f"WITH {_RK}, f AS (SELECT qid, concept AS code, round(score * 100, 9) AS score FROM rk), w AS (SELECT *, row_number() OVER v AS r, lead(score) OVER v AS nx FROM f WINDOW v AS (PARTITION BY qid ORDER BY score DESC, code)) SELECT qid, code, round(least(greatest(score / 100, 0.7), 0.9), 9) AS confidence FROM w WHERE r = 1 AND score >= 50 AND (nx IS NULL OR score - nx >= 0.5)")
def fuzzy_accept(spark, sf):
    """LNK24: a good score that is clear of the next code's."""
    r = ranked(spark, sf).select("qid", F.col("concept").alias("code"), F.round(F.col("score") * 100, 9).alias("score"))
    return ln.fuzzy_accept(r, 50.0, 0.5).select("qid", "code", F.round("confidence", 9).alias("confidence"))


@query(f"""WITH {_RK}, g AS (SELECT qid, concept AS code, score, round(1 / (1 + rank), 9) AS second FROM rk), h AS (SELECT *, max(second) OVER (PARTITION BY qid) AS top FROM g)
SELECT qid, code, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(0.5 * round(score, 12) + 0.5 * second, 9) DESC, code) AS INT) AS rank FROM h WHERE top >= 0.5 AND top < 0.8""")
def confidence_gate(spark, sf):
    """LNK18: a second scorer gates and blends."""
    r = ranked(spark, sf).select("qid", F.col("concept").alias("code"), "score", F.round(1 / (1 + F.col("rank")), 9).alias("second"))
    out = ln.confidence_gate(r)
    from pyspark.sql import Window as W

    return out.select("qid", "code", F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round("blend", 9)), "code")).alias("rank"))


@query(f"""WITH {_RK}, d AS (SELECT qid, concept AS code, row_number() OVER (PARTITION BY qid ORDER BY prio, concept) AS rank FROM rk),
u AS (SELECT qid, concept AS code, 1 AS g, rank FROM rk WHERE rank <= 8 UNION ALL SELECT qid, code, 2, rank FROM d), o AS (SELECT qid, code, min(g * 100000 + rank) AS at0 FROM u GROUP BY qid, code),
p AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY at0, code) AS pos, code FROM o) SELECT qid, CAST(pos AS INT) AS pos, code FROM p WHERE pos <= 39 UNION ALL SELECT qid, CAST(least(max(pos), 39) + 1 AS INT), 'NONE' FROM p GROUP BY qid""")
def candidate_pool(spark, sf):
    """LNK26: ranked codes, then others, then NONE."""
    from pyspark.sql import Window as W

    r = ranked(spark, sf).select("qid", F.col("concept").alias("code"), "rank", "prio")
    dense = r.select("qid", "code", F.row_number().over(W.partitionBy("qid").orderBy("prio", "code")).alias("rank"))
    return ln.candidate_pool(r.select("qid", "code", "rank"), dense)


@query("""WITH x AS (SELECT label, CAST(unnest(range(0, 64)) AS INT) AS dim, unnest(embedding) AS v FROM embeddings), m AS (SELECT label, dim, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY label, dim)
SELECT label, dim, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS value FROM m""")
def centroid_pool(spark, sf):
    """LNK14, LNK35: unit means of groups of vectors."""
    return ln.pooled(table(spark, sf, "embeddings"), "label")


@query("""WITH q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, vec_id AS code, list_dot_product(v, CAST(embedding AS DOUBLE[])) AS sim FROM q, embeddings WHERE vec_id <> qid)
SELECT qid, code, CAST(r AS INT) AS rank, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, code) AS r FROM s) WHERE r <= 3""")
def dense_topk(spark, sf):
    """LNK15: the three nearest vectors of the whole catalogue for every twentieth vector (a stated query set, a top-k report)."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("code"), F.col("embedding").alias("vector"))
    q = v.where("code % 20 = 0").select(F.col("code").alias("qid"), F.lit(0).alias("view"), "vector")
    return ln.dense_search(q, v, 3).select("qid", "code", "rank", F.round("sim", 6).alias("sim"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT vec_id AS qid, 0 AS view, v FROM e WHERE vec_id % 20 = 0 UNION ALL SELECT vec_id, 1, list_reverse(v) FROM e WHERE vec_id % 20 = 0),
s AS (SELECT qid, view, vec_id AS code, list_dot_product(q.v, e.v) AS sim FROM q, e WHERE vec_id <> qid), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, view ORDER BY sim DESC, code) AS r FROM s) WHERE r <= 15 AND sim >= 0.2),
m AS (SELECT qid, code, avg(sim) AS sim FROM t GROUP BY qid, code) SELECT qid, code, CAST(r AS INT) AS rank, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, code) AS r FROM m) WHERE r <= 3""")
def multi_view_search(spark, sf):
    """LNK16: the mean similarity over the views of a query, each view's best fifteen (a top-k report)."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("code"), F.col("embedding").cast("array<double>").alias("vector"))
    some = v.where("code % 20 = 0")
    q = some.select(F.col("code").alias("qid"), F.lit(0).alias("view"), "vector").unionByName(some.select(F.col("code").alias("qid"), F.lit(1).alias("view"), F.reverse("vector").alias("vector")))
    found = ln.dense_search(q, v, 15)
    return ln.mean_over_views(found, 3, 0.2).select("qid", "code", "rank", F.round("sim", 6).alias("sim"))


@query("""WITH a AS (SELECT vec_id AS qid, label AS code, 0.5 + (vec_id % 50) / 100.0 AS sim FROM embeddings), b AS (SELECT vec_id AS qid, (label + 1) % 10 AS code, 0.5 + (vec_id % 47) / 94.0 AS sim FROM embeddings),
u AS (SELECT qid, code, max(sim) AS sim FROM (SELECT * FROM a UNION ALL SELECT qid, code, 0.95 * sim FROM b) GROUP BY qid, code), w AS (SELECT *, row_number() OVER v AS r, lead(sim) OVER v AS nx FROM u WINDOW v AS (PARTITION BY qid ORDER BY round(sim, 9) DESC, code))
SELECT qid, code, round(sim, 6) AS sim FROM w WHERE r = 1 AND round(sim, 9) >= 0.8 AND (nx IS NULL OR round(sim, 9) - round(nx, 9) >= 0.03)""")
def view_merge_max(spark, sf):
    """LNK25: two views merged by the better similarity."""
    e = table(spark, sf, "embeddings")
    a = e.select(F.col("vec_id").alias("qid"), F.col("label").alias("code"), F.round(0.5 + (F.col("vec_id") % 50) / 100.0, 9).alias("sim"))
    b = e.select(F.col("vec_id").alias("qid"), ((F.col("label") + 1) % 10).alias("code"), (0.5 + (F.col("vec_id") % 47) / 94.0).alias("sim"))
    return ln.merge_views(a, b.withColumn("sim", F.round(F.col("sim") * 0.95, 9) / 0.95)).select("qid", "code", F.round("sim", 6).alias("sim"))


@query("""WITH f AS (SELECT doc_id, CAST(n_chars % 100 AS DOUBLE) / 100 AS lex, CAST(doc_id % 100 AS DOUBLE) / 100 AS emb, lang = 'en' AS inside FROM documents)
SELECT doc_id, round(0.6 * lex + 0.4 * emb + 0.05 * lex + CASE WHEN inside THEN 0.15 ELSE 0 END, 6) AS score FROM f""")
def hybrid_rerank(spark, sf):
    """LNK17: the blend of lexical and dense scores."""
    lex = (F.col("n_chars") % 100).cast("double") / 100
    s = ln.hybrid(lex, (F.col("doc_id") % 100).cast("double") / 100, lex, F.col("lang") == "en")
    return table(spark, sf, "documents").select("doc_id", F.round(s, 6).alias("score"))


@query("""WITH d AS (SELECT doc_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda w: w <> '')) AS t FROM documents), b AS (SELECT item_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda w: w <> '')) AS t FROM benchmark),
n AS (SELECT doc_id, item_id, count(*) AS n FROM (SELECT doc_id, unnest(t) AS w FROM d) x JOIN (SELECT item_id, unnest(t) AS w FROM b) y ON x.w = y.w GROUP BY doc_id, item_id)
SELECT n.doc_id, n.item_id, round(2.0 * n / (len(d.t) + len(b.t)), 6) AS f1, round(n / CAST(len(d.t) + len(b.t) - n AS DOUBLE), 6) AS jaccard FROM n JOIN d ON n.doc_id = d.doc_id JOIN b ON n.item_id = b.item_id""")
def token_overlap_pairs(spark, sf):
    """LNK23, EVL6: all texts that share any word with benchmark items, scored over all their distinct words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda w: w != ""))
    d = table(spark, sf, "documents").select("doc_id", words("text").alias("a")).select("doc_id", F.size("a").alias("na"), F.explode("a").alias("w"))
    b = table(spark, sf, "benchmark").select("item_id", words("text").alias("b")).select("item_id", F.size("b").alias("nb"), F.explode("b").alias("w"))
    # the benchmark is the small side: sizes travel with its words, and pairs are counted before they are shuffled
    near = d.join(b, "w").groupBy("doc_id", "na", "item_id", "nb").agg(F.count("*").alias("n"))
    return near.select("doc_id", "item_id", F.round(2.0 * F.col("n") / (F.col("na") + F.col("nb")), 6).alias("f1"), F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("jaccard"))


@query("""WITH n AS (SELECT 'R' || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS parent, 'R' || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || '.' || CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS VARCHAR) AS code, n_name AS name FROM nation),
a AS (SELECT code, name, parent FROM n UNION ALL SELECT DISTINCT 'R' || lpad(CAST(r_regionkey AS VARCHAR), 2, '0'), r_name, NULL FROM region), k AS (SELECT parent AS code, array_to_string(list_sort(list(code)), ',') AS children FROM a WHERE parent IS NOT NULL GROUP BY parent)
SELECT a.code, lower(replace(name, '_', ' ')) AS cons, CASE WHEN contains(a.code, '.') THEN 'disease' ELSE 'category' END AS level, parent, coalesce(children, '') AS children FROM a LEFT JOIN k ON a.code = k.code""")
def code_index(spark, sf):
    """SRC10, SRC11, SRC12: raw nodes as an index: spelling, level, parent told by the code, children, keys of the names."""
    n = code_rows(spark, sf)
    return ln.code_nodes(n).select("code", "cons", "level", "parent", F.array_join("children", ",").alias("children"))


def code_rows(spark, sf):
    """Regions as categories and nations as codes below them, written without a dot and without their parents."""
    from pyspark.sql import Window as W

    region = F.concat(F.lit("r"), F.lpad(F.col("n_regionkey").cast("string"), 2, "0"))
    place = (F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).cast("string")
    none = F.lit(None).cast("string").alias("parent")
    n = table(spark, sf, "nation").select(F.concat(region, place, F.lit("*")).alias("code"), F.col("n_name").alias("name"), none)
    return n.unionByName(table(spark, sf, "region").select(F.concat(F.lit("R"), F.lpad(F.col("r_regionkey").cast("string"), 2, "0")).alias("code"), F.col("r_name").alias("name"), none))


@query("""WITH n AS (SELECT n_nationkey, n_name AS name, 'R' || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || '.' || CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS VARCHAR) AS code FROM nation), c AS (SELECT c_custkey AS qid, c_custkey % 6 AS k, name, code FROM customer JOIN n ON c_nationkey = n_nationkey)
SELECT qid, CASE WHEN k IN (4, 5) THEN NULL ELSE code END AS code, CAST(CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 1.0 WHEN 3 THEN 0.75 ELSE 0.0 END AS DOUBLE) AS confidence, CASE k WHEN 0 THEN 'code' WHEN 1 THEN 'alias' WHEN 2 THEN 'name' WHEN 3 THEN 'backed' WHEN 4 THEN 'negated' ELSE 'none' END AS how FROM c""")
def code_match(spark, sf):
    """LNK19, LNK21, LNK24: the cascade of look-ups: a written code, an alias, a name, a name with a qualifier, nothing."""
    nodes = ln.code_nodes(code_rows(spark, sf))
    nation = table(spark, sf, "nation").join(nodes.select("code", "name"), F.col("n_name") == F.col("name"))
    aliases = nation.select(F.concat(F.lit("land "), "n_name").alias("alias"), "code", F.lit(0.9).alias("confidence"))
    c = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 6
    text = F.when(k == 0, F.concat(F.lit("see "), F.lower("code"))).when(k == 1, F.concat(F.lit("Land-"), "n_name")).when(k == 2, F.concat(F.lit("bị "), F.lower("n_name"))).when(k == 3, F.concat("n_name", F.lit(" unspecified"))).when(k == 4, F.col("n_name")).otherwise(F.concat(F.lit("no "), "n_name"))
    return ln.match_codes(c.select(F.col("c_custkey").alias("qid"), text.alias("text"), (k == 4).alias("negated")), nodes, aliases)


@query(f"""WITH {_RK}, m AS (SELECT qid, CASE WHEN qid % 3 = 0 THEN 'x' END AS code, CASE WHEN qid % 3 = 1 THEN 'negated' ELSE 'none' END AS how FROM q), l AS (SELECT qid, list(concept ORDER BY rank) AS l FROM rk WHERE rank <= 5 GROUP BY qid)
SELECT m.qid, array_to_string(CASE WHEN how = 'negated' THEN CAST([] AS VARCHAR[]) WHEN code IS NOT NULL THEN [code] ELSE coalesce(l, CAST([] AS VARCHAR[])) END, ',') AS codes FROM m LEFT JOIN l ON m.qid = l.qid""")
def linker_adapter(spark, sf):
    """LNK31: one code where it is sure, the first five candidates where it isn't, none for negated texts."""
    m = asked(spark, sf).select("qid", F.when(F.col("qid") % 3 == 0, "x").alias("code"), F.when(F.col("qid") % 3 == 1, "negated").otherwise("none").alias("how"))
    return ln.adapted(m, ranked(spark, sf).select("qid", F.col("concept").alias("code"), "rank")).select("qid", F.array_join("codes", ",").alias("codes"))


@query(f"""WITH {_RK}, a AS (SELECT qid, concept, rank, round(score, 12) AS score, ['SCDC', 'SCD', 'SBD', 'PSN', 'SBDC'][entry_id % 5 + 1] AS kind, entry_id % 4 <> 0 AS same, entry_id % 3 = 0 AS literal, entry_id % 2 = 0 AS named, entry_id % 7 = 0 AS brand_written, entry_id % 3 = 1 AS injection, entry_id % 5 = 2 AS oral,
  CASE WHEN entry_id % 6 = 0 THEN 5.0 END AS volume, qid % 2 = 0 AS by_mouth, qid % 3 = 0 AS by_injection, qid % 5 = 0 AS has_volume FROM rk),
u AS (SELECT *, injection AND kind IN ('SCD', 'SBD', 'PSN', 'SY') AS shot, has_volume AND coalesce(volume = 5.0, false) AS fits FROM a),
g AS (SELECT qid, arg_min({{'concept': concept, 'score': score, 'kind': kind, 'literal': literal, 'named': named, 'brand': brand_written}}, rank) AS t, bool_or(same) AS any_same, bool_or(fits) AS volume_met, max(score) FILTER (WHERE shot) AS shot_score,
  arg_min({{'concept': concept, 'score': score, 'fits': fits}}, ROW(-score, rank)) FILTER (WHERE shot AND same) AS i, count(*) FILTER (WHERE shot AND same) AS n_shots, bool_or(oral AND score >= 0.90) AS oral_there, bool_or(by_mouth) AS by_mouth, bool_or(by_injection) AS by_injection, bool_or(has_volume) AS has_volume FROM u GROUP BY qid),
d AS (SELECT *, t.kind IN ('SCDC', 'SBDC') AS component, t.kind = 'SCD' AND t.literal AND NOT by_injection AS plain FROM g),
w AS (SELECT qid, t, i, CASE WHEN NOT any_same THEN NULL WHEN t.score >= 1.0 AND (NOT has_volume OR volume_met) AND ((component AND NOT coalesce(t.score - shot_score <= 0.05, false)) OR plain) THEN 'full' WHEN plain AND t.score >= 0.95 AND by_mouth THEN 'by mouth'
  WHEN t.kind IN ('PSN', 'SBD', 'SY') AND t.score >= 0.75 AND NOT by_injection AND t.named AND (t.kind IN ('PSN', 'SBD') OR (t.brand AND t.score >= 0.90)) THEN 'brand' WHEN n_shots > 0 AND by_injection AND NOT oral_there AND i.score >= 0.90 THEN 'injection' WHEN n_shots > 0 AND i.fits THEN 'volume'
  WHEN n_shots = 1 AND component AND t.score - i.score <= 0.05 THEN 'only injection' END AS why FROM d)
SELECT qid, CASE WHEN why IN ('full', 'by mouth', 'brand') THEN t.concept ELSE i.concept END AS concept, why FROM w WHERE why IS NOT NULL UNION ALL SELECT rk.qid, rk.concept, 'fallback' FROM rk JOIN w ON rk.qid = w.qid WHERE rank = 2 AND why IS NULL""")
def guided_links(spark, sf):
    """LNK10: the ordered decisions over dosed candidates; here the second concept stands for the fallback."""
    r = ranked(spark, sf)
    n = F.col("entry_id")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("SCDC", "SCD", "SBD", "PSN", "SBDC")]), (n % 5 + 1).cast("int"))
    rows = r.select("qid", "concept", "rank", "score", kinds.alias("kind"), (n % 4 != 0).alias("same"), (n % 3 == 0).alias("literal"), (n % 2 == 0).alias("named"), (n % 7 == 0).alias("brand_written"), (n % 3 == 1).alias("injection"), (n % 5 == 2).alias("oral"), F.when(n % 6 == 0, 5.0).alias("volume"))
    q = asked(spark, sf).select("qid", (F.col("qid") % 2 == 0).alias("by_mouth"), (F.col("qid") % 3 == 0).alias("by_injection"), F.when(F.col("qid") % 5 == 0, F.array(F.lit(5.0))).otherwise(F.array().cast("array<double>")).alias("volumes"))
    return ln.guided(q, rows, r.where("rank = 2").select("qid", "concept"))


@query(f"""WITH {_RK}, p AS (SELECT qid, concept AS code, score FROM rk UNION ALL SELECT qid, 'NONE', 0.6 FROM q) SELECT qid, CASE WHEN code <> 'NONE' THEN code END AS code FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, code) AS r FROM p) WHERE r = 1""")
def rerank_argmax(spark, sf):
    """LNK27: the best of a pool, which may be none of its codes."""
    pool = ranked(spark, sf).select("qid", F.col("concept").alias("code"), "score").unionByName(asked(spark, sf).select("qid", F.lit("NONE").alias("code"), F.lit(0.6).alias("score")))
    return ln.argmax_with_none(pool)


@query(f"""WITH {_RK}, f AS (SELECT qid, concept AS code, round(score * 100, 9) AS score FROM rk WHERE rank = 1 AND round(score * 100, 9) >= 60), x AS (SELECT qid, min(concept) AS code FROM q JOIN e ON q.text = e.name WHERE e.prio = 0 GROUP BY qid)
SELECT qid, code FROM x UNION ALL SELECT qid, code FROM f WHERE qid NOT IN (SELECT qid FROM x)""")
def seed_link(spark, sf):
    """LNK30: exact surfaces, else a fuzzy match that is good enough."""
    q, e = asked(spark, sf), entries(spark, sf)
    fuzzy = ranked(spark, sf).where("rank = 1").select("qid", F.col("concept").alias("code"), F.round(F.col("score") * 100, 9).alias("score"))
    return ln.seed_link(q.select("qid", F.col("text").alias("surface")), e.where("prio = 0").select(F.col("name").alias("surface"), F.col("concept").alias("code")), fuzzy, 60.0)
