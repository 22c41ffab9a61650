"""Connected components of very many links, without collecting any of them.

First every task contracts its own links to a forest, so what follows has at most one link per node
and task. Where that many links fit one task, it finishes the work. Else alternating large-star and
small-star steps go on: each is a grouped minimum (with map-side partial sums, so a vertex with a
third of all links is one row per task) and a join back to the links, in which the links of the
largest vertices are salted. Every round is written to the shared scratch folder; the number of rounds
grows with the logarithm of the longest chain. The result is the same either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .runs import join_groups

#: Links (two numbers each) that one task contracts at once.
FEW = 200_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that isn't its component's smallest, and that smallest node."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        least = np.minimum(x, y)[apart]
        np.minimum.at(parent, x[apart], least)
        np.minimum.at(parent, y[apart], least)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    below = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[below], nodes[parent[below]]


def contracted(links: DataFrame, at_once: int) -> DataFrame:
    """``u, v`` with the same components: stars of at most ``at_once`` links of a task each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            held.append(np.stack([np.asarray(batch.column(k)) for k in (0, 1)]))
            n += batch.num_rows
            if n >= at_once:
                held = [np.stack(forest(*np.concatenate(held, axis=1)))]
                n = held[0].shape[1]
                if 2 * n >= at_once:  # too many nodes to go on with
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["u", "v"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*np.concatenate(held, axis=1))], names=["u", "v"])

    return links.where("u != v").select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(work, "u long, v long")


def _star(links: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """Links (u, v) of either direction -> links from each larger end to the smallest neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("members")).select("u", F.least("u", "m").alias("m"), "members")
    least = scratch.keep(least)
    out = join_groups(both, least, ["u"], F.col("v"))
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` for every node that some row (u, v) of ``links`` names; component is its smallest node.

    Repeated links, both directions and loops are fine; rows with a null end are ignored.
    """
    known = scratch.keep(contracted(links.select("u", "v"), max(FEW, 1)))
    if known.count() <= FEW:
        after = scratch.keep(contracted(known.coalesce(1), 2 * FEW + 1))
        scratch.drop(known)
        known = after
    else:
        before = mark = None
        while mark is None or mark != before:
            after = scratch.keep(_star(_star(known, True, scratch), False, scratch))
            state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31)).alias("h")).first()
            scratch.drop(known)
            known, before, mark = after, mark, (state["n"], state["h"])
    return known.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(known.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
