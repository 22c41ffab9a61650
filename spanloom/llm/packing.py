"""Hierarchical residual packing: partitions best-fit locally, emit nearly full bins, merge the rest.

One pass encodes whole texts, cuts only those longer than a sequence, and packs what each partition
holds by best fit. Bins that are nearly full are done. Underfull bins go on as items: in each round
fewer tasks take them together and best-fit them anew, until one round no longer closes bins. Every
round is written to the shared scratch folder, so a lost executor repeats its round only.

Defined results: a null text is an empty one; every document has at least the end id. Repeated rows
are packed each. An empty table gives no rows. Extra columns are ignored whatever their names. Equal
lengths are packed in the order of the rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, textnum
from .common import Scratch, columns_of, parallelism

#: A bin with at most this share of its room left is done. This and the two numbers below say how tightly bins are
#: packed against how much is moved again; no piece depends on them, only its place.
SLACK = 1 / 128
#: Items that one local best fit takes; a partition with more packs them group by group.
GROUP = 200_000
#: Underfull bins that a task of a merging round takes at most.
MERGE = 50_000


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best fit of decreasing lengths: each item's bin and its offset there.

    The open bins are kept by the room they have left; a bit set finds the smallest room that does.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, n_bins = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = size, n_bins
            n_bins += 1
        bins[i], offsets[i] = b, size - room
        room -= need
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins, offsets


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """Starts and lengths of a document's pieces: whole ones of ``size``, a shorter one first."""
    first = length % size or size
    return [(0, min(first, length)), *[(s, size) for s in range(first, length, size)]]


def _member_type(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("offset", T.LongType()),
    ])


class _Bins:
    """Bins as Arrow columns: ``sequence_id, fill, done, members``."""

    def __init__(self, fill: np.ndarray, counts: np.ndarray, members: pa.StructArray, key: np.ndarray):
        self.fill, self.counts, self.members, self.key = fill, counts, members, key

    def packed(self, size: int) -> "_Bins":
        """The same members in the bins that a best fit makes of these."""
        if not len(self.fill):
            return self
        new, offset = best_fit(self.fill, size)
        order = np.lexsort((offset, new))
        begin = np.concatenate(([0], np.cumsum(self.counts)[:-1]))
        take = textnum.take_stretches(np.arange(len(self.members)), begin[order], self.counts[order])
        moved = self.members.take(pa.array(take))
        fields = [moved.field(i) for i in range(moved.type.num_fields)]
        fields[-1] = pa.array(np.asarray(fields[-1]) + np.repeat(offset[order], self.counts[order]), pa.int64())
        n = int(new.max()) + 1
        first = np.searchsorted(new[order], np.arange(n))
        return _Bins(
            np.bincount(new, self.fill, n).astype(np.int64),
            np.bincount(new, self.counts, n).astype(np.int64),
            pa.StructArray.from_arrays(fields, fields=list(moved.type)),
            self.key[order][first],
        )

    def take(self, which: np.ndarray) -> "_Bins":
        begin = np.concatenate(([0], np.cumsum(self.counts)[:-1])) if len(self.counts) else self.counts
        rows = textnum.take_stretches(np.arange(len(self.members)), begin[which], self.counts[which])
        return _Bins(self.fill[which], self.counts[which], self.members.take(pa.array(rows, pa.int64())), self.key[which])

    def joined(self, other: "_Bins") -> "_Bins":
        return _Bins(np.append(self.fill, other.fill), np.append(self.counts, other.counts), pa.concat_arrays([self.members, other.members]), np.append(self.key, other.key))

    def batch(self, done: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        at = pa.array(np.concatenate(([0], np.cumsum(self.counts))), pa.int32())
        columns = [pa.array(self.key, pa.int64()), pa.array(self.fill, pa.int64()), pa.array(done, pa.bool_()), pa.ListArray.from_arrays(at, self.members)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _settle(bins: _Bins, size: int, slack: int, schema: pa.Schema, last: bool) -> tuple[pa.RecordBatch | None, _Bins]:
    """The bins that are done as a batch, and the others; at the end of a partition all, marked."""
    full = bins.fill >= size - slack
    if last:
        return bins.batch(full, schema) if len(full) else None, bins.take(np.zeros(0, np.int64))
    done = bins.take(np.flatnonzero(full))
    return done.batch(np.ones(len(done.fill), bool), schema) if len(done.fill) else None, bins.take(np.flatnonzero(~full))


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, size: int = 2048, eos: int = 0, slack: float = SLACK) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark, path = df.sparkSession, tokenizer or bpe.default_tokenizer()
    rows = columns_of(df, doc_id=doc_id, text=text)
    member = _member_type(rows.schema["doc_id"].dataType)
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("fill", T.LongType()), T.StructField("done", T.BooleanType()), T.StructField("members", T.ArrayType(member))])
    room = int(size * slack)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, struct = _arrow(schema), _arrow(member)
        key = TaskContext.get().partitionId() << 40
        held: _Bins | None = None
        for batch in batches:
            index: list[int] = []
            found: list[tuple[int, int, int, int]] = []
            for lo, hi, ids, counts in textnum.whole_rows(bpe.encoder(path).encode(batch.column(1))):
                wide = np.insert(ids.astype("<u4"), np.cumsum(counts), eos)
                ends = np.cumsum(counts + 1)
                for row, begin, end in zip(range(lo, hi), (ends - counts - 1).tolist(), ends.tolist(), strict=True):
                    for k, (start, n) in enumerate(cut(end - begin, size)):
                        index.append(row)
                        found.append((k, start, n, zlib.crc32(wide[begin + start : begin + start + n])))
            if not found:
                continue
            f = np.array(found, np.int64)
            columns = [batch.column(0).take(pa.array(index)), *[pa.array(f[:, i]) for i in range(4)], pa.array(np.zeros(len(f), np.int64))]
            members = pa.StructArray.from_arrays([c.cast(x.type) for c, x in zip(columns, struct, strict=True)], fields=list(struct))
            now = _Bins(f[:, 2], np.ones(len(f), np.int64), members, key + np.arange(len(f)))
            key += len(f)
            done, now = _settle(now, size, 0, out, False)
            if done:
                yield done
            held = held.joined(now) if held else now
            if len(held.fill) > GROUP:
                done, held = _settle(held.packed(size), size, room, out, False)
                if done:
                    yield done
        if held:
            done, _ = _settle(held.packed(size), size, room, out, True)
            if done:
                yield done

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _arrow(schema)
        held: _Bins | None = None
        for batch in batches:
            lists = batch.column(3)
            now = _Bins(np.asarray(batch.column(1)), np.asarray(lists.value_lengths()).astype(np.int64), lists.flatten(), np.asarray(batch.column(0)))
            held = held.joined(now) if held else now
            if len(held.fill) > GROUP:
                done, held = _settle(held.packed(size), size, room, out, False)
                if done:
                    yield done
        if held:
            done, _ = _settle(held.packed(size), size, room, out, True)
            if done:
                yield done

    scratch = Scratch(spark, "pack")
    level = scratch.keep(rows.mapInArrow(encode, schema))
    parts = [level.where("done")]
    rest = level.where("not done")
    left, tasks = rest.count(), parallelism(spark)
    while left > 1:
        tasks = max(1, tasks // 4, -(-left // MERGE))
        # dealt in turns: items of like fill in one task would fit badly
        level = scratch.keep(rest.repartition(tasks).mapInArrow(merge, schema))
        parts.append(level.where("done"))
        rest, before = level.where("not done"), left
        left = rest.count()
        if tasks == 1 or left > 0.98 * before and tasks == max(1, -(-left // MERGE)):
            break
    whole = parts[0]
    for p in [*parts[1:], rest]:
        whole = whole.unionByName(p)
    return whole.select(F.explode("members").alias("m"), "sequence_id").select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
