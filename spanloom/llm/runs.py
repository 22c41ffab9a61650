"""Work on groups of sorted Arrow rows without a call of Python per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups that are salted in a join, at most; they are broadcast, so any other holds at most a thousandth of the rows.
HOT = 1000
#: Rows that a group needs to be salted, and the tasks that it is then dealt to.
LARGE, SALTS = 10_000, 64


def by_runs(batches: Iterator[pa.RecordBatch], keys: int, work: Callable[[pa.Table], list[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Calls ``work`` with tables that hold whole runs of equal first ``keys`` columns of sorted rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            x = np.asarray(batch.column(k))
            change[1:] |= x[1:] != x[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        begins = not held or any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(keys))
        if last or (held and begins):
            whole = [*held, batch.slice(0, last)] if last else held
            yield from work(pa.Table.from_batches(whole))
            held, batch = [], batch.slice(last)
        held.append(batch)
    if held:
        yield from work(pa.Table.from_batches(held))


def run_bounds(table: pa.Table, keys: int) -> np.ndarray:
    """Where runs of equal first ``keys`` columns begin, and the number of rows."""
    change = np.ones(table.num_rows + 1, bool)
    change[1:-1] = False
    for k in range(keys):
        x = table.column(k).to_numpy()
        change[1:-1] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], spread: Column) -> DataFrame:
    """``rows`` joined with ``groups``, which has one row per key and its number of rows as ``members``.

    The ``HOT`` largest groups are dealt to ``SALTS`` tasks each, by a hash of ``spread``, so no key
    sends more than a thousandth of all rows to one task. Adds all columns of ``groups`` but ``members``.
    ``groups`` is read twice, so it should be a kept table. The join is a shuffle at every size, so small inputs tell what large ones will need.
    """
    hot = F.broadcast(groups.where(F.col("members") > LARGE).orderBy(F.desc("members"), *on).limit(HOT).select(*on, F.lit(SALTS).cast("long").alias("_salts")))
    salted = rows.withColumn("_spread", spread).join(hot, on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_spread"), "_salts"), F.lit(0))).drop("_salts", "_spread")
    each = F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1)
    copies = groups.drop("members").join(hot, on, "left").withColumn("_salt", F.explode(each)).drop("_salts")
    return salted.join(copies.hint("merge"), [*on, "_salt"]).drop("_salt")


def in_tiles(rows: DataFrame, key: str, tile: int) -> DataFrame:
    """Adds ``i, j, side``: every two rows of a key meet in exactly one (key, i, j).

    A key with at most ``tile`` rows is one tile. A larger one is cut into parts by a hash of ``rid``;
    the rows of part c go to the tiles of c and each other part. In a tile of two parts only rows of
    different ``side`` are to be compared.
    """
    large = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > tile).select(key, F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    return spread_tiles(rows.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1))))


def spread_tiles(rows: DataFrame) -> DataFrame:
    """The same where ``parts`` tells in how many parts a row's key is to be cut; takes that column away."""
    cut = rows.withColumn("part", F.expr("cast(pmod(xxhash64(rid), parts) as int)"))
    met = cut.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    kept = [c for c in rows.columns if c != "parts"]
    return met.select(*kept, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).alias("side"))
