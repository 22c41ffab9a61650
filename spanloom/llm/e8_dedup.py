"""Embedding near-dedup by lattice hashing: E8 cells in several tables, cosine verified.

Each table projects the unit vectors on eight random directions and finds the nearest point of the
E8 lattice. A vector is filed under its own cell and under the ``probes`` neighbouring cells that lie
nearest to it. Vectors that meet in a cell, at least one of them at home there, are compared by
cosine in double precision; what the meeting proves is kept as a spanning forest, never as all pairs.
Connected components of these links then hold every link, so each vector's number of links is
counted inside its component. Both comparisons run in tiles of at most ``tile`` rows a side, so a
cell or component of any size is spread over many tasks.

What a cell's tile receives first is each vector in one signed byte per component, with a bound of the
error: it tells which members have a possible link there, and only their whole vectors are shipped.
The bound is never too small, so no link is lost by it.

With the default width and tables, vectors of cosine 0.93 share no cell with a probability of about
2e-5, closer ones less.

Defined results: vectors of different label or length aren't compared. A vector that is null, empty,
zero, or holds null or non-finite components, or whose label is null, links with nothing. Equal
vectors are compared once and counted each. Components of any finite size count, as vectors are divided by
their largest component before anything else. Rows that repeat an id are vectors of their own; a null
id is never the smallest unless its component has no other. An empty table gives no rows. Extra
columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import Scratch, columns_of, parallelism
from .components import connected_components
from .runs import by_runs, in_tiles, run_bounds

THRESHOLD, TABLES, PROBES, WIDTH, TILE = 0.93, 8, 4, 0.22, 2048


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: steps to the neighbouring cells."""
    found = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            found.append(v)
    found += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


STEPS = _minimal_vectors()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def nearest_lattice_point(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the better of the two cosets' nearest points."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def cells(unit: np.ndarray, tables: int, probes: int, width: float, seed: int = 7) -> np.ndarray:
    """(rows, tables, 1 + probes) hashes of the home cell and of the nearest neighbouring cells."""
    out = np.empty((len(unit), tables, 1 + probes), np.uint64)
    for t in range(tables):
        directions = np.random.default_rng((seed, t, unit.shape[1])).normal(size=(unit.shape[1], 8)) / np.sqrt(unit.shape[1])
        x = unit @ directions / width
        home = nearest_lattice_point(x)
        ahead = (x - home) @ STEPS.T
        chosen = np.argpartition(-ahead, probes, axis=1)[:, :probes] if probes else np.zeros((len(x), 0), int)
        points = np.concatenate((home[:, None, :], home[:, None, :] + STEPS[chosen]), axis=1)
        h = np.full(points.shape[:2], t + 1, np.uint64)
        for d, c in enumerate(np.moveaxis(np.rint(points * 2).astype(np.int64).view(np.uint64), 2, 0)):
            h = textnum.mix(h + c, d + 31)
        out[:, t] = h
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long lists as a matrix of doubles."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; divided by their largest component first, so no square over- or underflows."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1)[:, None]


def rounded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as whole numbers from -127 to 127, what they are to be multiplied by, and the length of what is lost."""
    scale = np.abs(unit).max(1) / 127
    whole = np.rint(unit / scale[:, None])
    lost = np.linalg.norm(unit - whole * scale[:, None], axis=1) * (1 + 1e-6) + 1e-9
    return whole.astype(np.int8), scale, lost


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a boolean link matrix."""
    n = len(links)
    free, out = np.ones(n, bool), []
    for root in range(n):
        if not free[root]:
            continue
        free[root] = False
        front = [root]
        while front:
            u = front.pop()
            reached = np.flatnonzero(links[u] & free)
            free[reached] = False
            out += [(u, v) for v in reached.tolist()]
            front += reached.tolist()
    return out


#: Rows of a tile that are compared with all others at once.
AT_ONCE = 512


def _compared(home: np.ndarray, side: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Some members of a tile after the other, and which others each is compared with: one of the two is at home, and they are of different sides if there are two."""
    for begin in range(0, len(home), AT_ONCE):
        rows = slice(begin, min(begin + AT_ONCE, len(home)))
        pairs = home[rows, None] | home[None]
        if side.any():
            pairs &= side[rows, None] != side[None]
        pairs[np.arange(rows.stop - begin), np.arange(begin, rows.stop)] = False
        yield rows, pairs


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = "label", threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept, rid``: one row per row of ``df``."""
    scratch = Scratch(df.sparkSession, "e8")
    named = {"vec_id": vec_id, "embedding": embedding} | ({"label": label} if label else {})
    rows = columns_of(df, **named)
    if not label:
        rows = rows.withColumn("label", F.lit(0))
    finite = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x != 0)")
    hashes = F.xxhash64("label", "embedding").alias("c1"), F.xxhash64(F.lit(1), "label", "embedding").alias("c2")
    rows = scratch.keep(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "embedding", F.coalesce(finite & F.col("label").isNotNull(), F.lit(False)).alias("valid"), *hashes))
    classes = rows.where("valid").groupBy("c1", "c2").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"))
    classes = scratch.keep(classes.join(rows.select("rid", "embedding", F.xxhash64("label", F.size("embedding")).alias("group")), "rid"))

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                sizes = np.asarray(part.column(1).value_lengths())
                for size in np.unique(sizes):
                    some = part.filter(pa.array(sizes == size))
                    v = _matrix(some.column(1))
                    h = cells(unit_rows(v), tables, probes, width)
                    h = textnum.mix(h + np.asarray(some.column(2)).view(np.uint64)[:, None, None], 3)
                    each = tables * (1 + probes)
                    home = np.zeros(h.shape, bool)
                    home[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(some.column(0)), each)), pa.array(home.reshape(-1))], names=["cell", "rid", "home"])

    places = scratch.keep(classes.select("rid", "embedding", "group").mapInArrow(filed, "cell long, rid long, home boolean"))
    shared = places.groupBy("cell").agg(F.min("rid").alias("a"), F.max("rid").alias("b"), F.max("home").alias("some")).where("a != b and some").select("cell")
    met = places.join(shared, "cell", "left_semi")

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths())
            for size in np.unique(sizes):
                some = batch.filter(pa.array(sizes == size))
                whole, scale, lost = rounded(unit_rows(_matrix(some.column(1))))
                yield pa.RecordBatch.from_arrays([some.column(0), textnum.binaries(whole.ravel(), np.full(len(whole), size)), pa.array(scale), pa.array(lost)], names=["rid", "whole", "scale", "lost"])

    short = scratch.keep(classes.select("rid", "embedding").mapInArrow(shortened, "rid long, whole binary, scale double, lost double"))

    def possible(table: pa.Table) -> list[pa.RecordBatch]:
        """The members of each tile that may have a link there."""
        at, home, side, scale, lost = run_bounds(table, 3), *[table.column(c).to_numpy() for c in ("home", "side", "scale", "lost")]
        whole = table.column("whole").combine_chunks()
        sizes = np.asarray(pc.binary_length(whole))
        found = np.zeros(table.num_rows, bool)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a < 2 or not home[a:b].any() or (sizes[a:b] != sizes[a]).any():
                continue
            x = np.frombuffer(b"".join(v.as_buffer() for v in whole[a:b]), np.int8).reshape(b - a, -1).astype(np.float64) * scale[a:b, None]
            for rows, pairs in _compared(home[a:b], side[a:b]):
                near = x[rows] @ x.T
                near += lost[None, a:b] * (1 + lost[a:b][rows, None])
                near += lost[a:b][rows, None]
                found[a:b][rows] = (pairs & (near >= threshold - 1e-9)).any(1)
        return table.select(["cell", "i", "j", "rid", "home", "side"]).filter(pa.array(found)).combine_chunks().to_batches()

    def unit(table: pa.Table) -> np.ndarray:
        return unit_rows(_matrix(table.column("embedding").combine_chunks()))

    def link(table: pa.Table) -> list[pa.RecordBatch]:
        found: list[np.ndarray] = []
        at, rid, home, side = run_bounds(table, 3), *[table.column(c).to_numpy() for c in ("rid", "home", "side")]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            v = unit(table.slice(a, b - a))
            links = np.zeros((b - a, b - a), bool)
            for rows, pairs in _compared(home[a:b], side[a:b]):
                links[rows] = pairs & (v[rows] @ v.T >= threshold)
            if links.any():
                found.append(rid[a:b][np.array(_forest(links))])
        if not found:
            return []
        pairs = np.concatenate(found)
        return [pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])]

    columns = ["cell", "i", "j", "rid", "home", "side"]
    tiles = in_tiles(met, "cell", tile).join(short, "rid").select(*columns, "whole", "scale", "lost")
    tiles = tiles.repartition(parallelism(df.sparkSession), "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "rid")
    some = scratch.keep(tiles.mapInArrow(lambda b: by_runs(b, 3, possible), "cell long, i int, j int, rid long, home boolean, side boolean"))
    tiles = some.join(classes.select("rid", "embedding"), "rid").select(*columns, "embedding")
    links = tiles.repartition(parallelism(df.sparkSession), "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "rid").mapInArrow(lambda b: by_runs(b, 3, link), "u long, v long")
    found = scratch.keep(connected_components(links, scratch))

    def count(table: pa.Table) -> list[pa.RecordBatch]:
        at, side, copies = run_bounds(table, 3), table.column("side").to_numpy(), table.column("copies").to_numpy()
        total = np.zeros(table.num_rows, np.int64)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            v = unit(table.slice(a, b - a))
            if not side[a:b].any() and table.column("i")[a] != table.column("j")[a]:
                continue
            for rows, pairs in _compared(np.ones(b - a, bool), side[a:b]):
                total[a:b][rows] = (pairs & (v[rows] @ v.T >= threshold)).astype(np.float64) @ copies[a:b]
        return [pa.RecordBatch.from_arrays([table.column("rid").combine_chunks(), pa.array(total)], names=["rid", "n"])]

    grouped = classes.join(found.select(F.col("node").alias("rid"), "component"), "rid").select("component", "rid", "copies", "embedding")
    spread = in_tiles(grouped, "component", tile).select("component", "i", "j", "rid", "copies", "embedding", "side")
    counts = spread.repartition(parallelism(df.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j", "rid").mapInArrow(lambda b: by_runs(b, 3, count), "rid long, n long")
    counts = counts.groupBy("rid").agg(F.sum("n").alias("n"))

    known = classes.select("c1", "c2", "rid", "copies").join(found.withColumnRenamed("node", "rid"), "rid", "left").join(counts, "rid", "left")
    known = known.select("c1", "c2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rid").alias("component"))
    members = scratch.keep(rows.where("valid").select("rid", "vec_id", "c1", "c2").join(known, ["c1", "c2"]).select("rid", "vec_id", "n_links", "component"))
    least = members.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    judged = members.join(least, "component").select("rid", "vec_id", "n_links", "component_id")
    alone = rows.where("not valid").select("rid", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return judged.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "rid")
