"""Lattice dedup and multi-index search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import e8_dedup, multi_index


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for _ in range(60):
        base = rng.normal(size=32)
        for _ in range(rng.integers(1, 6)):
            v = base / np.linalg.norm(base) + rng.normal(size=32) * rng.choice([0, 0.03, 0.05])
            rows.append((n, v.tolist(), int(rng.integers(0, 2)) if rng.random() < 0.2 else 1))
            n += 1
    odd = [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [None] + [1.0] * 31, 1), (904, rows[0][1], None), (905, [], 1), (906, [1.0, 2.0], 1), (None, rows[0][1], rows[0][2])]
    return rows, odd, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit(1)).withColumn("RID", F.lit(2))


def test_nearest_lattice_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 2
    p = e8_dedup.nearest_lattice_point(x)
    assert np.allclose(np.rint(p * 2), p * 2) and (np.rint(p.sum(1)) % 2 == 0).all()
    d = ((x - p) ** 2).sum(1)
    for s in e8_dedup.STEPS:  # no neighbour is nearer
        assert (((x - p - s) ** 2).sum(1) >= d - 1e-9).all()
    assert d.max() <= 1 + 1e-9  # the covering radius


@pytest.mark.parametrize("tile", [2048, 7])
def test_links(spark, vectors, tile):
    rows, odd, df = vectors
    got = {r["vec_id"]: r for r in e8_dedup.near_duplicates(df, tile=tile).collect()}
    ids = [r[0] for r in rows] + [None]
    x = np.array([r[1] for r in rows] + [odd[-1][1]])
    label = np.array([r[2] for r in rows] + [odd[-1][2]])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    reach = near | np.eye(len(x), dtype=bool)
    for _ in range(8):
        reach = reach @ reach
    for i, k in enumerate(ids):
        assert got[k]["n_links"] == near[i].sum()
        assert got[k]["component_id"] == min(ids[j] for j in np.flatnonzero(reach[i]) if ids[j] is not None)
        assert got[k]["kept"] == (got[k]["component_id"] == k)
    for k in range(900, 907):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert e8_dedup.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize(("block", "chunk"), [(1 << 16, 1 << 13), (50, 10)])
def test_search(spark, vectors, block, chunk):
    rows, odd, df = vectors
    got = multi_index.nearest(df, F.col("vec_id") % 10 == 0, block=block, chunk=chunk).collect()
    ids = np.array([r[0] for r in rows] + [904])
    x = np.array([r[1] for r in rows] + [rows[0][1]])
    hit = total = 0
    for q in range(0, len(rows), 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(abs(r["score"] - d[list(ids).index(r["vec_id"])]) < 1e-12 for r in mine)
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        hit, total = hit + len({r["vec_id"] for r in mine} & set(want.tolist())), total + 10
    assert hit / total >= 0.9
    few = df.where("vec_id < 4 or vec_id >= 900")
    assert {r["n"] for r in multi_index.nearest(few, F.col("vec_id") == 0).groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {4}
    assert multi_index.nearest(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_index_finds_every_code_within():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 1 << 16, (500, 4)).astype(np.uint16)
    codes[:50] = codes[0] ^ (1 << rng.integers(0, 16, (50, 4))).astype(np.uint16)
    index = multi_index.BlockIndex(codes)
    for r in (0, 3, 8, 20, 64):
        want = [i for i, c in enumerate(codes) if sum(bin(int(a ^ b)).count("1") for a, b in zip(c, codes[0], strict=True)) <= r]
        assert index.within(codes[0], r).tolist() == want


def test_norms_that_over_or_underflow(spark):
    rows = [
        (1, [1e-200, 3e-200] + [1e-200] * 6), (2, [3e-200] + [1e-200] * 7),  # cosine 0.75
        (3, [1e200] * 8), (4, [2e200] * 8), (5, [5e-324] * 8), (6, [1.7e308] * 7 + [1.6e308]), (6, [1.0] * 8),  # cosine 1 or nearly
        (7, [1.0, -1.0] * 4), (8, [1e300, -1e300] * 4),
    ]
    got = {}
    for r in e8_dedup.near_duplicates(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"]))
    assert got[1] == [(0, 1)] and got[2] == [(0, 2)] and got[7] == [(1, 7)] and got[8] == [(1, 7)]
    assert all(x == (4, 3) for i in (3, 4, 5, 6) for x in got[i]) and len(got[6]) == 2


def test_rounded_vectors_bound_the_cosine():
    rng = np.random.default_rng(5)
    u = e8_dedup.unit_rows(rng.normal(size=(200, 24)) * np.exp(rng.normal(size=(200, 24)) * 2))
    whole, scale, lost = e8_dedup.rounded(u)
    x = whole * scale[:, None]
    assert (np.abs(x @ x.T - u @ u.T) <= lost[:, None] + lost[None] * (1 + lost[:, None]) + 1e-12).all()


def test_planted_pairs_at_the_threshold(spark):
    """Pairs of cosine 0.93 to 0.95 among vectors that don't link: none is missed."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        a = e8_dedup.unit_rows(rng.normal(size=(1, 64)))[0]
        b = rng.normal(size=64)
        b -= (b @ a) * a
        c = 0.93 + 1e-9 + 0.02 * (i % 10) / 10
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist(), 1)]
    got = e8_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(r["component_id"] == r["vec_id"] // 2 * 2 for r in got)


def test_search_each_length_and_size(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(40)]
    rows += [(100, [1e200] * 8), (101, [1e200] * 7 + [1.1e200]), (102, [1e-200] * 8), (200, [1.0, 2.0]), (201, [1.0, 2.5]), (202, [4.0, 2.0]), (300, [1.0] * 3), (40, [9.0] * 8), (40, [9.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in multi_index.nearest(df, F.col("vec_id") % 100 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert [x[1:] for x in sorted(got[200])] == [(201, 0.5), (202, 3.0)] and 300 not in got  # no other vector of its length
    first = sorted(got[100])[0]
    assert first[1] == 101 and abs(first[2] / 1e199 - 1) < 1e-9
    x, ids = np.array([v for _, v in rows if len(v) == 8]), np.array([i for i, v in rows if len(v) == 8])
    d = np.sqrt(((x - x[0]) ** 2).sum(1))
    d[0] = np.inf
    assert [r[1] for r in sorted(got[0])] == ids[np.lexsort((ids, d))[:5]].tolist()
    twins = multi_index.nearest(df, F.col("vec_id") == 40, k=1).collect()
    assert [(r["vec_id"], r["score"]) for r in twins] == [(40, 0.0), (40, 0.0)]  # rows that repeat an id are each other's nearest
    assert multi_index.distances(np.array([[1e-200, 0.0], [3e200, 4e200]]), np.zeros(2)) / [1e-200, 5e200] == pytest.approx([1, 1], rel=1e-15)
