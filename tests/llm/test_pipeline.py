"""The pipeline: each stage against a plain version of its own input; queries with SQL."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import quality, toxicity
from spanloom.llm.queries import ORACLES, QUERIES
from tests.llm.test_text_operators import plain_windows


def test_stages(spark, sf, tmp_path):
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before, after = docs.toPandas(), out.toPandas()
        seen.append((len(before), len(after)))
        if k < 4:
            assert out.columns == docs.columns and (after.n_chars == after.text.str.len()).all()
        if k == 0:
            good, names = quality.with_quality(docs, lab)
            assert set(after.doc_id) == {r["doc_id"] for r in good.where(F.col(names["accepted"]) == 1).collect()}
        if k == 1:
            assert set(after.doc_id) == {r["doc_id"] for r in toxicity.judge(docs, lab).where("predicted = 0").collect()}
        if k == 2:
            assert dict(zip(after.doc_id, after.text, strict=True)) == plain_windows(list(zip(before.doc_id, before.text, strict=True)))
        if k == 3:
            before = before.sort_values("doc_id")  # of copies the smallest id stays, in whatever order the rows come
            gone = before[~before.doc_id.isin(after.doc_id)]
            assert len(after) == after.doc_id.nunique() and (before[before.text.duplicated()].doc_id.isin(gone.doc_id)).all()
        if k == 4:
            assert set(after.doc_id) == set(before.doc_id) and after.groupby("sequence_id").length.sum().max() <= 2048
        docs = out
    assert seen[0][0] > seen[0][1] > seen[1][1] == seen[2][1] > seen[3][1]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = QUERIES[name](spark, sf)
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    as_rows = lambda rows, at: sorted(str([r[at.index(c)] for c in sorted(at)]) for r in rows)
    assert as_rows([tuple(r) for r in df.collect()], df.columns) == as_rows(found.fetchall(), columns)


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, text ids, extra columns with clashing names, no ``n_chars``, and an empty table."""
    long_ = "A plain sentence stands here and says something. " * 400
    rows = [("a", "x\ny\nz"), ("b", "x\ny\nz"), ("b", "x\ny\nz"), (None, None), (None, ""), ("c", long_), ("d", long_ + "More."), ("e", None)]
    spark.createDataFrame([(i, 1, 0) for i in "abcde"], "doc_id string, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "Score": F.lit(1), "rid": F.lit(2), "h": F.lit("x"), "evidence": F.lit(0.5)})
    for given in (docs, docs.where("false")):
        now = given
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            if k < 4:
                assert out.columns == given.columns
                at = f"{tmp_path}/{given.count()}-{k}"
                out.write.parquet(at)
                now = spark.read.parquet(at)
            if k == 3 and given is docs:
                kept = {(r["doc_id"], r["text"]) for r in now.collect()}
                assert ("a", "x\ny\nz") in kept and ("c", long_) in kept and len(kept) == 3  # all texts without words are one
        assert (out.count() == 0) == (given is not docs)
