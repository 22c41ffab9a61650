"""Order MinHash near-dedup, verified by banded alignment.

Every text becomes its lower-cased words. Each of ``sketches`` hash functions picks the ``picked``
smallest occurrence-labelled five-word shingles and keeps them in the order of the text; texts that
agree on one such ordered pick are candidates. Agreement is likely only if the shingles agree *and*
stand in the same order, that is if the edit similarity is high. A candidate is a link if banded
alignment of the words gives ``1 - edits / longer length >= threshold``.

Short texts have too few shingles for that. Those of at most ``short`` words are also candidates if
they share a stretch of words that no link between them can be without: a link has k edits at most,
so one of k + 1 pieces of the longer text is whole in the other. All links between them are found.

Exact copies are folded first, so they never meet each other as candidates. The first round aligns
the members of the buckets of each row's ``first`` sketches with one member. Buckets whose members
still belong to different components are then compared in tiles of bounded size, spread over many
tasks: lengths and a histogram of words (an edit moves it by 2 at most) first tell which members have
a possible partner, only their words are shipped, and their pairs are aligned in the tile. A tile
aligns a pair only in the first sketch that the two agree on and only while nothing else in the tile
connects them, and emits a forest of at most its members, never its pairs. No link between different
texts that share a pick is lost to the components.

Defined results: null, empty and blank texts have no words and are copies of each other. Texts with
fewer words than a shingle are one shingle. Rows with a null id take part; a component's id is the
smallest id in it, null only if all are null, and one row of it is kept: the smallest id, ties by the
order of the rows. Ids may be of any type that can be ordered. An empty table gives no rows. Extra columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum
from .common import Scratch, columns_of, parallelism
from .components import connected_components
from .runs import by_runs, join_groups, run_bounds, spread_tiles

SHINGLE, SKETCHES, PICKED, THRESHOLD = 5, 64, 2, 0.8
#: The low bits of a key tell its sketch; those of stretches are all set.
SKETCH_BITS = 127
#: Bins of the histograms of words that rule out pairs: of the one kept per text, of a tile's, and of a pair's.
SIGNATURE, COARSE, BINS = 512, 1024, 4096
#: Members of a bucket that one part of a tile compares, and words that it holds.
TILE, TILE_WORDS = 2048, 1 << 21
#: Members of a tile from which on their sketches are made anew, to align no pair twice.
RESKETCH = 64
#: Pairs with one hub that a task aligns.
SPOKES = 4096
#: Words up to which texts are found exactly.
SHORT = 64


def sketch_words(w: np.ndarray, counts: np.ndarray, shingle: int = SHINGLE, sketches: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """(rows, sketches) ordered picks of rows that have at least one word, as 64-bit hashes."""
    rows = len(counts)
    begin = np.cumsum(counts) - counts
    n = np.maximum(counts - shingle + 1, 1)
    at = textnum.take_stretches(np.arange(len(w)), begin, n)
    owner = np.repeat(np.arange(rows), n)
    with np.errstate(over="ignore"):
        grams = np.zeros(len(at), np.uint64)
        ends = (begin + counts)[owner]
        for k in range(shingle):
            inside = at + k < ends
            grams = textnum.mix(grams + np.where(inside, w[np.minimum(at + k, len(w) - 1)], np.uint64(0)), k + 1)
        # occurrence labels: equal shingles of a row get 0, 1, 2, ... in the order of the text
        key = grams ^ textnum.mix(owner.astype(np.uint64), 77)
        order = np.argsort(key, kind="stable")
        run = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        first = np.flatnonzero(run)
        label = np.empty(len(at), np.uint64)
        label[order] = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        labelled = textnum.mix(grams + label * np.uint64(0x9E3779B97F4A7C15), 5)
        bits = np.uint64(max(len(at).bit_length(), 24))  # the same for all but enormous calls, so a row gets the same picks in any company
        places, high = np.arange(len(at), dtype=np.uint64), ~((np.uint64(1) << bits) - np.uint64(1))
        starts = np.cumsum(n) - n
        out = np.empty((rows, sketches), np.uint64)
        rank = np.empty(len(at), np.uint64)
        most = np.uint64(2**64 - 1)
        for s in range(sketches):
            np.multiply(labelled ^ np.uint64((s * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & (2**64 - 1)), np.uint64(0xBF58476D1CE4E5B9), out=rank)
            np.bitwise_xor(rank, rank >> np.uint64(31), out=rank)
            np.bitwise_and(rank, high, out=rank)
            np.bitwise_or(rank, places, out=rank)
            found = np.empty((picked, rows), np.int64)
            for k in range(picked):
                least = np.minimum.reduceat(rank, starts)
                where = (least & ~high).astype(np.int64)
                found[k] = np.where(least == most, np.iinfo(np.int64).max, where)
                rank[where[least != most]] = most
            found.sort(axis=0)
            total = np.full(rows, s + 1, np.uint64)
            for k in range(picked):
                there = found[k] != np.iinfo(np.int64).max
                total = np.where(there, textnum.mix(total + labelled[np.where(there, found[k], 0)], k + 11), total)
            out[:, s] = total
    return out


def stretch_lengths(short: int, threshold: float) -> dict[int, np.ndarray]:
    """Lengths of stretches, and for each whether a text of 0, 1, ... ``short + 1`` words needs its stretches of that length.

    A text of n words can be linked to those of n to L words with L - n <= k = (1 - threshold) L; with
    each it shares one of the L words' k + 1 pieces, thus a stretch of the shortest piece's length.
    """
    needed: dict[int, np.ndarray] = {}
    for longer in range(1, short + 1):
        most = int(longer * (1 - threshold) + 1e-9)
        if most:  # else only copies are links
            of = needed.setdefault(max(longer // (most + 1), 1), np.zeros(short + 2, bool))
            of[max(longer - most, 1) : longer + 1] = True
    return needed


def stretch_keys(w: np.ndarray, counts: np.ndarray, short: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the different stretches that short rows share with what they can be linked to."""
    begin = np.cumsum(counts) - counts
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for length, needed in stretch_lengths(short, threshold).items():
        of = np.flatnonzero(needed[np.minimum(counts, short + 1)] & (counts >= length))
        n = counts[of] - length + 1
        at = textnum.take_stretches(np.arange(len(w)), begin[of], n)
        key = np.full(len(at), length, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(length):
                key = textnum.mix(key + w[at + k], k + 41)
        rows.append(np.repeat(of, n))
        keys.append(key)
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def banded_edits(a: np.ndarray, b: np.ndarray, most: int, least: int = 0) -> int:
    """Word edits (insert, delete, replace) that turn ``a`` into ``b``, or ``most + 1`` if more.

    Bit-parallel: a column's differences are two bit sets, of which only the band of width
    ``2 * most + 1`` around the diagonal is kept. The band is widened until the edits fit into it;
    ``least`` is a known lower bound of them, below which no band is tried.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    same = int(np.argmin(np.append(a == b[: len(a)], False)))  # what both begin with
    a, b = a[same:], b[same:]
    same = int(np.argmin(np.append((a == b[len(b) - len(a) :])[::-1], False)))  # and end with
    a, b = a[: len(a) - same], b[: len(b) - same]
    if not len(a):
        return len(b)
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | (1 << i)
    columns = b.tolist()
    band = max(8, len(b) - len(a), least)
    while True:
        band = min(band, most)
        found = _edits_within(places, len(a), columns, band)
        if found <= band or band >= most:
            return min(found, most + 1)
        band *= 4


def _edits_within(places: dict[int, int], n: int, columns: list[int], band: int) -> int:
    """The edits if they are at most ``band``, else some larger number.

    Column j's window has the rows j - band to j + band; its lowest bit is row j - band. Rows above
    the first match nothing and so count the columns, as the top row has to. The score follows the
    window's last row along its diagonal, and from where that meets row n on, row n.
    """
    width = 2 * band + 1
    window, last = (1 << width) - 1, width - 1
    rise, fall, score = (window >> band) << band, 0, min(band, n)
    for j, x in enumerate(columns, 1):
        match, low = places.get(x, 0), j - band - 1
        match = (match >> low if low >= 0 else match << -low) & window
        free = ((((match & rise) + rise) ^ rise) | match | fall) & window
        right = fall | (window & ~(free | rise))
        left = free & rise
        if j + band <= n:
            score += 1 - (free >> last)
        else:
            row = n - j + band
            score += (right >> row & 1) - (left >> row & 1)
        down = free >> 1
        rise = left | (window & ~(down | right))
        fall = down & right
    return score


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, bins: int = BINS) -> bool:
    """Whether the words' edit similarity is at least ``threshold``.

    An edit changes the histogram of words by 2 at most and that of neighbouring pairs by 4, which
    rules out most pairs without alignment.
    """
    longer = max(len(a), len(b))
    most = int(longer * (1 - threshold) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if longer < 32:
        return banded_edits(a, b, most) <= most
    moved = _moved(a % bins, b % bins, bins)
    if moved > 2 * most:
        return False
    # an edit takes away two neighbouring pairs of words at most and brings two
    pairs = [(x[1:] * np.uint32(2654435761) + x[:-1]) >> np.uint32(18) for x in (a, b)]
    turned = _moved(*pairs, 1 << 14)
    return turned <= 4 * most and banded_edits(a, b, most, max(moved // 2, turned // 4)) <= most


def _moved(a: np.ndarray, b: np.ndarray, bins: int) -> int:
    """How far apart two histograms are."""
    return int(np.abs(np.bincount(a, minlength=bins) - np.bincount(b, minlength=bins)).sum())


def histograms(w: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """(rows, bins) counts of words, 255 at most; equal words fall into one bin."""
    n = np.bincount(np.repeat(np.arange(len(counts)), counts) * bins + (w % w.dtype.type(bins)).astype(np.int64), minlength=len(counts) * bins)
    return np.minimum(n, 255).astype(np.uint8).reshape(len(counts), bins)


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose rows hold ``counts`` values each, compressed; words that repeat take little room."""
    pack, ends = zstandard.ZstdCompressor(level=1).compress, np.cumsum(counts).tolist()
    return pa.array([pack(values[a:b].tobytes()) for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())


def unpacked(column: pa.Array, kind: type) -> list[np.ndarray]:
    """The rows of :func:`packed`."""
    unpack = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(unpack(x.as_buffer()), kind) for x in column]


def prepared(rows: DataFrame, shingle: int, sketches: int, picked: int, short: int, threshold: float) -> DataFrame:
    """``rid, doc_id, t1, t2, c1, c2, n_words, picks, signature, words`` of rows ``doc_id, text, t1, t2``: one pass over whole texts.

    The stretches of short texts stand behind the ``sketches`` picks.
    """
    schema = T.StructType([
        T.StructField("rid", T.LongType()), rows.schema["doc_id"], T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType()), T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType()),
        T.StructField("n_words", T.LongType()), T.StructField("picks", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType()), T.StructField("words", T.BinaryType()),
    ])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, w, counts in textnum.whole_rows(textnum.words(batch.column(1))):
                full = counts > 0
                with np.errstate(over="ignore"):
                    begin = np.cumsum(counts) - counts
                    place = (np.arange(len(w)) - np.repeat(begin, counts)).astype(np.uint64)
                    c1 = textnum.per_row(textnum.mix(w + place * np.uint64(0x9E3779B97F4A7C15), 21), counts, np.add)
                    c2 = textnum.per_row(textnum.mix(w ^ textnum.mix(place, 22), 23), counts, np.add)
                w &= np.uint64(0xFFFFFFFF)  # what is kept of the words; tiles sketch them again
                picks = sketch_words(w, counts[full], shingle, sketches, picked).ravel() if full.any() else np.zeros(0, np.uint64)
                row, keys = stretch_keys(w, counts, short, threshold)
                order = np.argsort(np.concatenate((np.repeat(np.flatnonzero(full), sketches), row)), kind="stable")
                numbers = np.concatenate((np.tile(np.arange(sketches), int(full.sum())), np.full(len(keys), SKETCH_BITS))).astype(np.uint64)
                picks = (np.concatenate((picks, keys)) & ~np.uint64(SKETCH_BITS) | numbers)[order]
                n_picks = np.where(full, sketches, 0) + np.bincount(row, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rid + np.arange(hi - lo), pa.int64()),
                        *[batch.column(k).slice(lo, hi - lo) for k in (0, 2, 3)],
                        pa.array(c1.view(np.int64)),
                        pa.array(c2.view(np.int64)),
                        pa.array(counts, pa.int64()),
                        textnum.ragged(picks.view(np.int64), n_picks).cast(pa.list_(pa.int64())),
                        packed(histograms(w, counts, SIGNATURE).ravel(), np.full(hi - lo, SIGNATURE)),
                        packed(w.astype(np.uint32), counts),
                    ],
                    names=schema.names,
                )
                rid += hi - lo

    return rows.mapInArrow(hashed, schema)


def verified(stars: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """The rows ``u, v`` of ``stars`` (u, v, salt) whose words (``rid, words``) are similar enough.

    The words of a hub u go to one task per salt, so many spokes don't meet in one.
    """
    hubs = stars.groupBy("u").agg(F.max("salt").alias("salts")).join(words.select(F.col("rid").alias("u"), F.col("words").alias("a")).hint("merge"), "u")
    hubs = hubs.select("u", F.explode(F.expr("sequence(0L, salts)")).alias("salt"), "a")
    both = stars.join(words.select(F.col("rid").alias("v"), F.col("words").alias("b")).hint("merge"), "v").join(hubs.hint("merge"), ["u", "salt"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(a, b, threshold) for a, b in zip(unpacked(batch.column(2), np.uint32), unpacked(batch.column(3), np.uint32), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(check, "u long, v long")


def hashes_of(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` with one document of each group of near copies; ids of any type."""
    scratch = Scratch(df.sparkSession, "one-of-each")
    id_ = F.col(f"`{doc_id}`")

    def key(of: Column) -> list[Column]:
        return [of.isNull().alias("k0"), F.coalesce(of.cast("string"), F.lit("")).alias("k1")]

    kept = near_duplicates(df, doc_id, text, **options).where("kept").select(*key(F.col("doc_id")), "t1", "t2")
    kept = scratch.keep(kept)
    on = ["k0", "k1", "t1", "t2"]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *key(id_), *hashes_of(F.col(f"`{text}`")))
    found = rows.join(kept, on, "left_semi")
    if scratch.keep(rows.select(*on)).groupBy(*on).count().where("count > 1").limit(1).count():
        found = found.dropDuplicates(on)  # rows that repeat id and text
    return found.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def _near(moved_at: np.ndarray, hist: np.ndarray, x: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far rows ``y`` are from row x, and which of them aren't farther than ``moved_at`` allows."""
    moved = (np.maximum(hist[y], hist[x]) - np.minimum(hist[y], hist[x])).sum(1, dtype=np.int32)
    return moved, moved <= moved_at[y]


def partners(n: np.ndarray, component: np.ndarray, side: np.ndarray, hist: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of a tile, in the order of length: the longer rows of other components that aren't ruled out, and how far they are.

    ``component`` may change in between.
    """
    order = np.argsort(n, kind="stable")
    counts, split = n[order], bool(side.any())
    last = np.searchsorted(counts, np.floor(counts / threshold + 1e-6), "right")
    moved_at = 2 * np.floor(n * (1 - threshold) + 1e-9)
    for k, x in enumerate(order.tolist()):
        y = order[k + 1 : last[k]]
        y = y[component[y] != component[x]]
        if split:
            y = y[side[y] != side[x]]
        if len(y):
            moved, fits = _near(moved_at, hist, x, y)
            if fits.any():
                yield x, y[fits], moved[fits]


def possible(table: pa.Table, threshold: float) -> list[pa.RecordBatch]:
    """The rows of each tile that have a possible partner there."""
    at, side, n, component = run_bounds(table, 3), *[table.column(c).to_numpy() for c in ("side", "n", "component")]
    hist = np.concatenate(unpacked(table.column("signature"), np.uint8)).reshape(-1, SIGNATURE)
    found = np.zeros(table.num_rows, bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if (component[a:b] == component[a]).all():
            continue
        for x, y, _ in partners(n[a:b], component[a:b], side[a:b], hist[a:b], threshold):
            found[a + x] = True
            found[a + y] = True
    return table.drop_columns(["signature"]).filter(pa.array(found)).combine_chunks().to_batches()


def linked(table: pa.Table, threshold: float, shingle: int, sketches: int, picked: int) -> list[pa.RecordBatch]:
    """A forest of links ``u, v`` between the components of each tile."""
    at, side, n, component, key = run_bounds(table, 3), *[table.column(c).to_numpy() for c in ("side", "n", "component", "h")]
    words = unpacked(table.column("words"), np.uint32)
    found: list[tuple[int, int]] = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        names, group = np.unique(component[a:b], return_inverse=True)
        if len(names) < 2:
            continue
        hist = histograms(np.concatenate(words[a:b]), n[a:b], COARSE)
        # an earlier sketch's tiles take the pairs that agree there; in small tiles aligning twice costs less than sketching again
        before = np.zeros((b - a, 0), np.uint64)
        if b - a > RESKETCH:
            before = sketch_words(np.concatenate(words[a:b]).astype(np.uint64), n[a:b], shingle, sketches, picked)[:, : key[a] & SKETCH_BITS]
        own = group.copy()
        for x, y, moved in partners(n[a:b], group, side[a:b], hist, threshold):
            apart = ~(before[y] == before[x]).any(1)
            for z in y[apart][np.argsort(moved[apart], kind="stable")].tolist():
                if group[z] != group[x] and similar(words[a + x], words[a + z], threshold):
                    found.append((names[own[x]], names[own[z]]))
                    group[group == group[z]] = group[x]
    if not found:
        return []
    u, v = np.array(found).T
    return [pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])]


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, sketches: int = SKETCHES, picked: int = PICKED, threshold: float = THRESHOLD, first: int = 8, short: int = SHORT, tile: int = TILE) -> DataFrame:
    """``rid, doc_id, component_id, kept, t1, t2`` of each row of ``df``; t1 and t2 are hashes of the text."""
    if sketches >= SKETCH_BITS:
        raise ValueError(f"fewer than {SKETCH_BITS} sketches")
    scratch = Scratch(df.sparkSession, "omh")
    docs = scratch.keep(prepared(columns_of(df, doc_id=doc_id, text=text).select("doc_id", "text", *hashes_of(F.col("text"))), shingle, sketches, picked, short, threshold))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    classes = docs.groupBy("c1", "c2").agg(F.min(order).alias("first"), F.first("n_words").alias("n"), F.min_by("picks", order).alias("picks"))
    classes = scratch.keep(classes.select("c1", "c2", F.col("first.rid").alias("rid"), F.col("first.doc_id").alias("least"), "n", "picks"))
    buckets = classes.select("rid", "n", F.explode("picks").alias("h"))
    shared = buckets.groupBy("h").agg(F.min("rid").alias("hub"), F.max("rid").alias("other"), F.count("*").alias("members")).where("hub != other")
    shared = shared.select("h", "hub", "members", F.ceil(F.col("members") / SPOKES).alias("salts"))
    shared = scratch.keep(join_groups(buckets, scratch.keep(shared), ["h"], F.col("rid")))
    # from here on only texts that share a pick with another one count
    met = docs.select("rid", "signature", "words").hint("merge").join(shared.select("rid").distinct(), "rid")
    met = scratch.keep(met)
    stars = shared.where((F.col("h").bitwiseAND(SKETCH_BITS) < first) & (F.col("rid") != F.col("hub"))).groupBy(F.col("hub").alias("u"), F.col("rid").alias("v")).agg(F.min(F.pmod(F.xxhash64("rid"), "salts")).alias("salt"))
    stars = scratch.keep(stars)
    found = scratch.keep(connected_components(verified(stars, met, threshold), scratch))

    def placed() -> DataFrame:
        """All bucket members with the component they are in by now."""
        known = shared.join(found.withColumnRenamed("node", "rid"), "rid", "left")
        return scratch.keep(known.select("h", "rid", "n", F.coalesce("component", "rid").alias("component")))

    # one member of every component of a bucket meets one of the first component's
    now = placed()
    parts = now.groupBy("h", "component").agg(F.min("rid").alias("rid"))
    first_of = parts.groupBy("h").agg(F.min(F.struct("component", "rid")).alias("f"), F.count("*").alias("members")).where("members > 1")
    first_of = scratch.keep(first_of.select("h", "f", "members", F.ceil(F.col("members") / SPOKES).alias("salts")))
    pairs = join_groups(parts, first_of, ["h"], F.col("rid")).where("component != f.component")
    pairs = pairs.groupBy(F.col("f.rid").alias("u"), F.col("rid").alias("v")).agg(F.min(F.pmod(F.xxhash64("rid"), "salts")).alias("salt"))
    tried = stars.select(F.col("u").alias("lo"), F.col("v").alias("hi"))
    pairs = pairs.join(tried, (F.least("u", "v") == F.col("lo")) & (F.greatest("u", "v") == F.col("hi")), "left_anti")
    found = scratch.keep(connected_components(verified(scratch.keep(pairs), met, threshold).unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v"))), scratch))

    now = placed()
    mixed = now.groupBy("h").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("members"), F.sum("n").alias("words")).where("a != b")
    mixed = mixed.select("h", "members", F.ceil(F.greatest(F.col("members") / tile, F.col("words") / TILE_WORDS)).cast("int").alias("parts"))
    members = join_groups(now, scratch.keep(mixed), ["h"], F.col("rid")).join(met.select("rid", "signature").hint("merge"), "rid")
    columns, tasks = ["h", "i", "j", "rid", "n", "component", "side"], parallelism(df.sparkSession)  # few bytes may mean much work
    dealt = spread_tiles(members).select(*columns, "signature").repartition(tasks, "h", "i", "j").sortWithinPartitions("h", "i", "j", "rid")
    some = scratch.keep(dealt.mapInArrow(lambda b: by_runs(b, 3, lambda table: possible(table, threshold)), "h long, i int, j int, rid long, n long, component long, side boolean"))
    dealt = some.join(met.select("rid", "words").hint("merge"), "rid").select(*columns, "words")
    dealt = dealt.repartition(tasks, "h", "i", "j").sortWithinPartitions("h", "i", "j", "rid")
    links = dealt.mapInArrow(lambda b: by_runs(b, 3, lambda table: linked(table, threshold, shingle, sketches, picked)), "u long, v long")
    joined = scratch.keep(connected_components(links, scratch)).select(F.col("node").alias("component"), F.col("component").alias("whole"))

    of_class = classes.select("c1", "c2", "rid", "least").join(found.withColumnRenamed("node", "rid"), "rid", "left")
    of_class = of_class.select("c1", "c2", "rid", "least", F.coalesce("component", "rid").alias("component")).join(joined, "component", "left")
    of_class = scratch.keep(of_class.select("c1", "c2", "rid", "least", F.coalesce("whole", "component").alias("component")))
    head = of_class.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), "rid")).alias("head"), F.count("*").alias("members"))
    head = head.select("component", F.col("head.id").alias("component_id"), F.col("head.rid").alias("head"), "members")
    of_class = join_groups(of_class.select("c1", "c2", "rid", "component"), scratch.keep(head), ["component"], F.col("rid")).select("c1", "c2", "component_id", "head")
    return docs.select("rid", "doc_id", "c1", "c2", "t1", "t2").join(of_class, ["c1", "c2"]).select("rid", "doc_id", "component_id", (F.col("rid") == F.col("head")).alias("kept"), "t1", "t2")
