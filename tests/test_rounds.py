"""Registered queries on odd rows and on plans of larger tables, against their SQL or plain loops."""

import datetime as dt
import glob
import os

import duckdb
import pyarrow as pa
import pytest

from spanloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def wanted(name, folder, digits=9):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    found = con.execute(catalogue.oracle_sql()[name])
    return plain([d[0] for d in found.description], found.fetchall(), digits)


def plain(columns, rows, digits=9):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(r[i], digits) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


def got(spark, name, folder, digits=9):
    df = catalogue.queries()[name](spark, str(folder))
    return plain(df.columns, [tuple(r) for r in df.collect()], digits)


@pytest.fixture
def conf(spark):
    """Settings for one test."""
    kept = {}

    def put(**settings):
        for k, v in settings.items():
            kept.setdefault(k, spark.conf.get(k, None))
            spark.conf.set(k, v)

    yield lambda settings: put(**settings)
    for k, v in kept.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_overlap_vote_at_the_end_of_a_day(spark, tmp_path):
    at = ["2024-01-01 23:59:59.4", "2024-01-01 23:59:59.5", "2024-01-01 23:59:58.5", "2024-01-02 23:59:59.999999", "1969-12-30 23:59:59.7", "1969-12-31 23:59:59.2"]
    rows = ", ".join(f"({i}::bigint, timestamp '{t}', 1::bigint, {i * 7.5}::double)" for i, t in enumerate(at))
    duckdb.sql(f"copy (select * from (values {rows}) t(event_id, ts, user_id, value)) to '{tmp_path}/events.parquet' (format parquet)")
    assert got(spark, "overlap_vote", tmp_path, 6) == wanted("overlap_vote", tmp_path, 6)


def test_segment_examples_under_adaptive_plans(spark, conf):
    conf({"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "3"})
    assert got(spark, "segment_examples", SF) == wanted("segment_examples", SF)


def test_multi_view_search_over_copies(spark, tmp_path):
    """Copies of a vector are equally near wherever they stand, and no task holds all pairs of its rows."""
    import tracemalloc

    import numpy as np

    from spanloom.operators import linking

    rng = np.random.default_rng(3)
    some = rng.normal(size=(41, 64))
    some = (some / np.linalg.norm(some, axis=1)[:, None]).astype("float32")
    rows = [(i, some[i * i % 41].tolist(), i % 10) for i in range(1500)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/made")
    os.rename(glob.glob(f"{tmp_path}/made/*.parquet")[0], f"{tmp_path}/embeddings.parquet")
    assert got(spark, "multi_view_search", tmp_path) == wanted("multi_view_search", tmp_path)
    big = rng.normal(size=(1 << 14, 8))
    tracemalloc.start()
    linking._nearest_rows(big[: 1 << 8], np.arange(1 << 8), big, np.arange(1 << 14), 15)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_relocate_stays_beside_its_text(spark, monkeypatch):
    from spanloom.operators import generators

    plan = catalogue.queries()["relocate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    docs = spark.createDataFrame([(1, "", [])], "doc_id long, text string, items array<struct<ord:int,surface:string>>")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: f)
    text = "ab abc ABC abc " * 2000
    items = [{"ord": k, "surface": "abc"} for k in range(6001)]
    batch = pa.RecordBatch.from_pylist([{"doc_id": d, "text": text, "items": items[::-1]} for d in range(40)])
    out = list(generators.relocate_lists(docs)(iter([batch])))
    assert len(out) > 1 and max(b.num_rows for b in out) <= generators.ROWS + 6000
    want = [15 * (k // 3) + (3, 7, 11)[k % 3] for k in range(6000)]
    assert pa.Table.from_batches(out)["start"].to_pylist() == want * 40


def test_segmented_texts_go_on_in_bounded_batches(spark, monkeypatch):
    from spanloom.operators import generators

    docs = spark.createDataFrame([(1, "")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: f)
    batch = pa.RecordBatch.from_pylist([{"doc_id": d, "text": "one of the\n many " * 20000} for d in range(8)])
    out = list(generators.segmented(docs, ["of the"])(iter([batch])))
    assert len(out) > 1 and max(len(b.column(2).flatten()) for b in out) < generators.CHARS + (1 << 19)
    made = pa.Table.from_batches(out)
    assert made["doc_id"].to_pylist() == list(range(8)) and made["segmented"][7].as_py().startswith("one of_the\nmany one of_the")
    assert made["seg2raw"][7].as_py()[:16] == [0, 1, 2, 3, 4, 5, None, 7, 8, 9, None, 12, 13, 14, 15, 16]


def linked(folder, parts, suppliers):
    """Catalogue and queries in which names, sizes and kinds repeat, and some do not."""
    kinds = ("ECONOMY", "STANDARD", "PROMO", "LARGE")
    words = ("red", "old", "hot", "big"), ("bolt", "ring", "rod", "gear")
    rows = ", ".join(f"({i}::bigint, '{words[0][i * 7 % 4]} {words[1][i // 3 % 4]}', 'Brand#{i * 5 % 6}', '{kinds[i // 5 % 4]} X', {i * 11 % 23 + 1 + 25 * (i % 2)}::int, 1.0::double)" for i in range(parts))
    duckdb.sql(f"copy (select * from (values {rows}) t(p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)) to '{folder}/part.parquet' (format parquet)")
    duckdb.sql(f"copy (select range as s_suppkey, 'S' as s_name, 1::int as s_nationkey, 1.0::double as s_acctbal from range({suppliers})) to '{folder}/supplier.parquet' (format parquet)")


def joined_rows(df):
    """The largest number of rows that a join of the finished query put out."""
    df.collect()
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        metric = node.metrics().get("numOutputRows")
        if "Join" in node.nodeName() and metric.isDefined():
            found.append(metric.get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return max(found)


def test_nearest_value_makes_no_pairs_of_entries(spark, tmp_path):
    linked(tmp_path, 900, 300)
    assert got(spark, "nearest_value", tmp_path) == wanted("nearest_value", tmp_path)
    assert joined_rows(catalogue.queries()["nearest_value"](spark, str(tmp_path))) < 30000


def test_link_cascade_looks_up_once(spark, tmp_path):
    linked(tmp_path, 900, 1600)
    assert got(spark, "link_cascade", tmp_path) == wanted("link_cascade", tmp_path)
    assert joined_rows(catalogue.queries()["link_cascade"](spark, str(tmp_path))) < 500000


def test_containment_score_joins_lists(spark, tmp_path, monkeypatch):
    from spanloom.operators import linking

    linked(tmp_path, 900, 300)
    want = wanted("containment_score", tmp_path)
    assert got(spark, "containment_score", tmp_path) == want
    assert joined_rows(catalogue.queries()["containment_score"](spark, str(tmp_path))) < len(want) / 100
    for name, most in (("CELL_QUERIES", 8), ("CELL_ENTRIES", 20), ("PIECE", 3)):
        monkeypatch.setattr(linking, name, most)
    assert got(spark, "containment_score", tmp_path) == want


def test_pair_scores_without_values(spark):
    from pyspark.sql import functions as F

    from spanloom.operators import linking

    q = spark.createDataFrame([(1, ["a", "b"], None), (2, ["b", "a"], 2.0), (3, ["b", "b", "c"], None), (4, ["z"], 1.0), (5, None, 1.0), (6, ["a", "b"], None), (7, [], 3.0)], "qid long, tokens array<string>, value double")
    e = spark.createDataFrame([(1, "x", ["a"], None, 1, False), (2, "x", ["a", "b"], 2.0, 0, True), (3, "y", ["b", "a"], 2.0, 0, None), (4, "y", ["c"], 5.0, None, False), (5, "y", None, 1.0, 1, False), (6, "x", ["a"], None, 1, False)], "entry_id long, concept string, tokens array<string>, value double, prio int, suppressed boolean")
    want = linking.score(q, e).select("qid", "entry_id", F.round("score", 9).alias("score"))
    found = linking.pair_scores(q, e, lambda s: F.round(s, 9))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) and found.count() == 15
