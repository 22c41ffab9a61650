"""Multi-index hashing: learned rotated binary codes, split into substrings, each indexed.

The codes are signs after several learned rotations (principal axes turned so that signs lose least),
fitted on a bounded sample. Rows are dealt into blocks; a block's task sorts its rows by every 16-bit
substring. Two codes that differ in fewer than ``(t + 1) * substrings`` bits agree in some substring
up to t bits (pigeonhole), so probing all substring values that near retrieves every code within that
radius, and many beyond it. What is retrieved is held against the full codes and reranked by exact
distance. t, the number of substrings and the radius of the full codes are learned: of all t and
numbers with which ``reach`` of the sample's true neighbours are retrieved, those that probe least. Where a block gives fewer than k rows, both grow until it has
k or is used up, so a query always gets k rows if there are as many.

Vectors of each length are an index of their own. Queries meet every block, in chunks; rows of a
block go to one task per chunk of queries.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do rows with a null id; only vectors of a query's length are its candidates. Components of
any finite size are fine: codes are made of scaled and clipped vectors, distances of the vectors as
they are. Ties go to the smaller id. Rows that repeat an id are rows of their own, and a query's own
row is left out by its place, not its id. An empty table gives no rows. Extra columns are ignored
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textnum
from .common import Scratch, columns_of, parallelism
from .runs import by_runs, run_bounds

#: Sampled rows that the rotations and radii are fitted on, at most; shared by vectors of different lengths.
SAMPLE = 20_000
#: Rows of a block, at most; a table that is smaller than a block for each task has smaller ones, down to ``SMALL``.
BLOCK, SMALL, CHUNK = 1 << 16, 1 << 14, 1 << 13
ROTATIONS, REACH, CLIP = 24, 0.96, 30.0
#: Sampled rows that the rotations are turned on, at most.
ROTATED = 5_000
_VALUES = np.arange(1 << 16, dtype=np.uint32)
_WEIGHT = np.array([bin(x).count("1") for x in range(1 << 16)], np.uint8)
#: All 16-bit differences, those with fewer bits first, and how many have at most t bits.
DIFFERENCES = _VALUES[np.argsort(_WEIGHT, kind="stable")].astype(np.uint16)
WITHIN = np.cumsum(np.bincount(_WEIGHT, minlength=17))


class Codes:
    """Learned binary codes: scale, mean and one matrix per rotation, and how far to search."""

    def __init__(self, sample: np.ndarray, rotations: int = ROTATIONS, reach: float = REACH, k: int = 10, rounds: int = 8, seed: int = 11):
        dims = sample.shape[1]
        self.scale = float(np.median(np.abs(sample).max(1))) if len(sample) else 1.0
        plain = self._plain(sample)
        self.mean = plain.mean(0) if len(sample) else np.zeros(dims)
        centred = plain - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred) if len(sample) else (None, np.eye(dims))
        turned, matrices = centred[:ROTATED] @ axes, []
        for r in range(rotations):
            turn = np.linalg.qr(np.random.default_rng((seed, r)).normal(size=(dims, dims)))[0]
            for _ in range(rounds if len(sample) else 0):
                u, _, v = np.linalg.svd(np.where(turned @ turn > 0, 1.0, -1.0).T @ turned)
                turn = (u @ v).T
            matrices.append(axes @ turn)
        self.matrix = np.concatenate(matrices, axis=1)
        self.bits = self.matrix.shape[1]
        self.near, used, self.radius = self._reach(plain, self.encode(sample), reach, k)
        self.matrix = self.matrix[:, : 16 * used]
        self.bits = self.matrix.shape[1]

    def _plain(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(x / self.scale, -CLIP, CLIP)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(rows, substrings) 16-bit substrings; the last is filled up with zeros."""
        bits = np.zeros((len(x), -(-self.bits // 16) * 16), bool)
        bits[:, : self.bits] = (self._plain(x) - self.mean) @ self.matrix > 0
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)

    def _reach(self, plain: np.ndarray, codes: np.ndarray, reach: float, k: int) -> tuple[int, int, int]:
        """Bits of a substring to probe, substrings to use, and bits of the whole code, that meet ``reach`` of the neighbours of 200 sampled rows."""
        if len(plain) < 2:
            return 16, codes.shape[1], self.bits
        off = []
        for i in np.linspace(0, len(plain) - 1, min(200, len(plain)), dtype=int):
            d = ((plain - plain[i]) ** 2).sum(1)
            d[i] = np.inf
            off.append(_WEIGHT[codes[np.argsort(d, kind="stable")[: min(k, len(plain) - 1)]] ^ codes[i]])
        off = np.concatenate(off)
        met = np.minimum.accumulate(off, axis=1)  # by the first 1, 2, ... substrings
        ways = [(int(WITHIN[t]) * (m + 1), t, m + 1) for t in range(17) for m in np.flatnonzero((met <= t).mean(0) >= reach)[:1]]
        _, near, used = min(ways)
        return near, used, int(np.quantile(off[:, :used].sum(1, dtype=np.int64), (1 + reach) / 2, method="higher"))


class BlockIndex:
    """The rows of one block, sorted by each substring of their codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable").astype(np.int32) for c in codes.T]
        self.starts = [np.concatenate(([0], np.cumsum(np.bincount(c, minlength=1 << 16)))).astype(np.int32) for c in codes.T]

    def met(self, code: np.ndarray, near: int) -> np.ndarray:
        """Every row with some substring that differs from that of ``code`` in at most ``near`` bits."""
        seen = np.zeros(len(self.codes), bool)
        differences = DIFFERENCES[: WITHIN[min(near, 16)]]
        for value, order, starts in zip(code, self.order, self.starts, strict=True):
            probe = (value ^ differences).astype(np.int64)
            begin = starts[probe]
            length = starts[probe + 1] - begin
            full = length > 0
            seen[order[textnum.take_stretches(np.arange(len(order)), begin[full], length[full])]] = True
        return np.flatnonzero(seen)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs from ``code`` in at most ``radius`` bits."""
        return self._held(self.met(code, radius // len(code)), code, radius)

    def _held(self, rows: np.ndarray, code: np.ndarray, radius: int) -> np.ndarray:
        return rows[_WEIGHT[self.codes[rows] ^ code].sum(1, dtype=np.int64) <= radius]

    def retrieved(self, code: np.ndarray, near: int, radius: int) -> np.ndarray:
        """The rows met within ``near`` bits of a substring whose whole code lies within ``radius``."""
        return self._held(self.met(code, near), code, radius)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x from q; squares that over- or underflow are taken of scaled differences."""
    with np.errstate(over="ignore", under="ignore"):
        d = np.sqrt(((x - q) ** 2).sum(1))
    odd = np.flatnonzero(~np.isfinite(d) | (d < 1e-140))
    if len(odd):
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            off = x[odd] / 2 - q / 2
            power = np.frexp(np.abs(off).max(1))[1]  # scaling by powers of two is exact
            far = np.ldexp(np.sqrt((np.ldexp(off, -power[:, None]) ** 2).sum(1)), power + 1)
            d[odd] = np.where(off.any(1), far, np.abs(x[odd] - q).max(1))
    return d


def search_block(x: np.ndarray, ids: np.ndarray, places: np.ndarray, queries: np.ndarray, own: np.ndarray, codes: Codes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its at most k nearest rows of the block: query's number, row, distance."""
    index, asked = BlockIndex(codes.encode(x)), codes.encode(queries)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    place = {p: i for i, p in enumerate(places.tolist())}
    for q in range(len(queries)):
        mine = place.get(int(own[q]))
        wanted, near, radius = min(k, len(x) - (mine is not None)), codes.near, codes.radius
        while True:
            rows = index.retrieved(asked[q], near, radius)
            if mine is not None:
                rows = rows[rows != mine]
            if len(rows) >= wanted:
                break
            near, radius = min(16, near + 1), min(codes.bits, radius + max(1, codes.bits // 16))
        d = distances(x[rows], queries[q])
        best = np.lexsort((ids[rows], d))[:k]
        out.append((np.full(len(best), q), rows[best], d[best]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _fitted(rows: DataFrame, sizes: int, sample: int, rotations: int, reach: float, k: int) -> dict[int, Codes]:
    """The codes for vectors of each length, from at most ``sample`` rows in all (one of each length at least)."""
    place = F.row_number().over(W.partitionBy("dims").orderBy(F.xxhash64("rid", "vec_id"), "rid"))
    drawn = rows.select("dims", "embedding", place.alias("place")).where(F.col("place") <= max(1, sample // sizes)).select("dims", "embedding").toArrow()
    dims, out = drawn.column("dims").to_numpy(), {}
    for n in np.unique(dims).tolist():
        some = drawn.column("embedding").filter(pa.array(dims == n)).combine_chunks()
        out[n] = Codes(np.asarray(some.flatten(), np.float64).reshape(len(some), n), rotations, reach, k)
    return out


def nearest(df: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, rotations: int = ROTATIONS, reach: float = REACH, sample: int = SAMPLE, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest other rows found for each row that ``is_query``.

    ``is_query`` is an expression over ``vec_id``.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "mih")
    finite = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x != 0)")
    rows = columns_of(df, vec_id=vec_id, embedding=embedding).where(F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull())
    rows = scratch.keep(rows.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")))
    rows = rows.withColumn("dims", F.size("embedding"))
    result = "query_id long, query_rid long, vec_id long, rid long, score double"
    counted = {r["dims"]: r["n"] for r in rows.groupBy("dims").agg(F.count("*").alias("n")).collect()}  # one row per length
    if not counted:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = _fitted(rows, len(counted), sample, rotations, reach, k)
    tasks = parallelism(spark)
    blocks = {n: max(-(-c // block), min(tasks, -(-c // min(block, SMALL)))) for n, c in counted.items()}
    of_length = F.create_map(*[F.lit(x) for item in blocks.items() for x in item])[F.col("dims")]
    rows = rows.withColumn("blocks", of_length)
    asked = rows.where(F.coalesce(is_query, F.lit(False)))
    chunks = max(1, -(-asked.count() // chunk))
    have = rows.select("dims", F.expr("cast(pmod(xxhash64(rid), blocks) as int)").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(False).alias("asked"), "rid", "vec_id", "embedding")
    want = asked.select("dims", F.explode(F.expr("sequence(0, cast(blocks - 1 as int))")).alias("block"), F.expr(f"cast(pmod(xxhash64(rid), {chunks}) as int)").alias("chunk"), F.lit(True).alias("asked"), "rid", "vec_id", "embedding")

    def search(table: pa.Table) -> list[pa.RecordBatch]:
        at, flag, dims = run_bounds(table, 3), table.column("asked").to_numpy(), table.column("dims").to_numpy()
        ids, rid = table.column("vec_id").to_numpy(), table.column("rid").to_numpy()
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            c = table.column("embedding").slice(a, b - a).combine_chunks()
            x = np.asarray(c.flatten(), np.float64).reshape(b - a, -1)
            m = a + int(np.argmax(np.append(flag[a:b], True)))
            if m in (a, b):
                continue
            number, row, d = search_block(x[: m - a], ids[a:m], rid[a:m], x[m - a :], rid[m:b], codes[int(dims[a])], k)
            columns = [ids[m:b][number], rid[m:b][number], ids[a:m][row], rid[a:m][row], d]
            out.append(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "query_rid", "vec_id", "rid", "score"]))
        return out

    dealt = have.unionByName(want).repartition("dims", "block", "chunk").sortWithinPartitions("dims", "block", "chunk", "asked", "rid")
    found = dealt.mapInArrow(lambda batches: by_runs(batches, 3, search), result)
    rank = F.row_number().over(W.partitionBy("query_id", "query_rid").orderBy("score", "vec_id", "rid"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
