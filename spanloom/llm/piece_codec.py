"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

Texts are cut into words before each blank that follows something else, and between any two
characters that stand side by side in no piece: no piece can lie across, so text without blanks comes
in short words too. Each distinct word is encoded once per worker. New words of equal length advance together:
for each end position and piece length, hashes of all words' substrings probe the sorted piece keys,
and the best way to reach the position is kept as a backpointer.

What "best" means follows the model file. In a unigram model a way's score is the sum of its pieces'
scores. A BPE model's ids come from merges, which no sum of scores reproduces; but a way is the
merges' result exactly if every two neighbouring pieces are stable, that is if merging their joined
text gives just these two again. So there the maximum is taken over ways whose neighbours are
stable, of which there is one per position. Stability is decided once per pair and remembered.
Ids thus equal those of the model's own library in both cases. Characters without a piece become
byte pieces, or the unknown id in a model without them.

Defined results: a null text counts as empty and has no ids; a null list of ids decodes to null.
Repeated rows are encoded each; an empty table gives no rows. Decoding gives the text back, except
that U+2581 reads as a blank, as in the library.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum
from .bpe import CachedEncoder
from .common import columns_of

BLANK = 0x2581
#: Remembered pairs of pieces; beyond it a worker begins anew.
PAIRS = 4_000_000
_ONLY_BLANK = np.zeros(256, bool)
_ONLY_BLANK[32] = True
_NOT_AFTER = _ONLY_BLANK.copy()
_NOT_AFTER[0x81] = True  # U+2581 ends with it
_KEPT: dict[str, "PieceEncoder"] = {}
#: Slots of the table of neighbouring characters; two that share a slot only keep a text uncut there.
BESIDE_BITS = 24


def _beside(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The slot of each pair of characters."""
    return ((left.astype(np.uint64) * np.uint64(0x9E3779B1) + right.astype(np.uint64) * np.uint64(0x85EBCA77)) >> np.uint64(8)) & np.uint64((1 << BESIDE_BITS) - 1)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoder(path: str) -> "PieceEncoder":
    """This worker's encoder for the model file, made at first use."""
    if path not in _KEPT:
        with open(path, "rb") as f:
            _KEPT[path] = PieceEncoder(f.read())
    return _KEPT[path]


class PieceEncoder(CachedEncoder):
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        rules = proto.normalizer_spec
        if proto.trainer_spec.model_type not in (1, 2) or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only unigram and BPE models without normalisation are supported")
        self.merges, self.dummy = proto.trainer_spec.model_type == 2, rules.add_dummy_prefix
        self.text = [p.piece for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        self.unknown = kinds.index(2)
        usable = {p: i for i, (p, kind) in enumerate(zip(self.text, kinds, strict=True)) if kind == 1}
        if any("▁" in p.lstrip("▁") for p in usable):
            raise ValueError("a piece holds a blank behind something else")
        self.id_of = usable
        self.byte = {int(p[3:5], 16): i for i, (p, kind) in enumerate(zip(self.text, kinds, strict=True)) if kind == 6}
        # what unknown characters cost in a unigram model
        self.unknown_score = min((self.score[i] for i in usable.values()), default=0.0) - 10.0
        self.longest = max(map(len, usable), default=1)
        codes = np.frombuffer("".join(usable).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) for p in usable])
        keys = textnum.hash_stretches(codes, ends - [len(p) for p in usable], ends)
        order = np.argsort(keys)
        self.piece_keys, self.piece_ids = keys[order], np.array(list(usable.values()), np.int64)[order]
        self.beside = np.zeros(1 << BESIDE_BITS, bool)
        inner = np.ones(max(len(codes) - 1, 0), bool)
        inner[ends[:-1] - 1] = False
        self.beside[_beside(codes[:-1][inner], codes[1:][inner])] = True
        raw = [bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else p.replace("▁", " ").encode() for p, kind in zip(self.text, kinds, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_n = np.array([len(r) for r in raw])
        self.raw_at = np.cumsum(self.raw_n) - self.raw_n
        self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self.fresh: dict[int, bool] = {}
        super().__init__()

    def _parts(self, column: pa.Array):
        data, offsets = textnum.buffers(column)
        for a, b, lo, hi in textnum.segments(data, offsets, 4 * textnum.SEGMENT, blank=_ONLY_BLANK, not_after=_NOT_AFTER):
            part = data[a:b]
            codes = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
            codes[codes == 32] = BLANK
            lead = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
            cuts = lead[np.clip(offsets[lo : hi + 1] - a, 0, b - a)]
            if self.dummy:  # a blank before each row that begins here and isn't empty
                begins = np.flatnonzero((np.diff(cuts) > 0) & (offsets[lo:hi] >= a))
                codes = np.insert(codes, cuts[begins], BLANK)
                added = np.zeros(len(cuts), np.int64)
                added[begins + 1] = 1
                cuts = cuts + np.cumsum(added)
            yield lo, hi, codes, cuts

    def _starts(self, part: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        blank = part == BLANK
        begins = np.zeros(len(part), bool)
        begins[1:] = (blank[1:] & ~blank[:-1]) | ~self.beside[_beside(part[:-1], part[1:])]
        begins[cuts[:-1][np.diff(cuts) > 0]] = True
        return np.flatnonzero(begins)

    def _merged(self, text: str) -> list[str]:
        """What merging gives: the best-scored neighbours first, the leftmost of equals."""
        parts, score, id_of = list(text), self.score, self.id_of
        near = [id_of.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            k, most = -1, -np.inf
            for i, piece in enumerate(near):
                if piece is not None and score[piece] > most:
                    k, most = i, score[piece]
            if k < 0:
                return parts
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del near[k]
            if k:
                near[k - 1] = id_of.get(parts[k - 1] + parts[k])
            if k < len(near):
                near[k] = id_of.get(parts[k] + parts[k + 1])

    def _stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the joined text of two pieces gives them back; -1 at the left stands for nothing."""
        key, back = np.unique((left + 1) << 32 | right, return_inverse=True)
        at = np.searchsorted(self.pair_keys, key)
        known = (at < len(self.pair_keys)) & (self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] == key) if len(self.pair_keys) else np.zeros(len(key), bool)
        out = np.zeros(len(key), bool)
        out[known] = self.pair_ok[at[known]]
        for i in np.flatnonzero(~known).tolist():
            pair = int(key[i])
            ok = self.fresh.get(pair)
            if ok is None:
                a, b = self.text[(pair >> 32) - 1] if pair >> 32 else "", self.text[pair & 0xFFFFFFFF]
                ok = self.fresh[pair] = not (a and a + b in self.id_of) and self._merged(a + b) == ([a, b] if a else [b])
            out[i] = ok
        return out[back]

    def _file_fresh(self) -> None:
        """Moves newly decided pairs to the sorted arrays."""
        if len(self.fresh) < 20_000:
            return
        if len(self.pair_keys) + len(self.fresh) > PAIRS:
            self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        keys = np.concatenate((self.pair_keys, np.array(list(self.fresh), np.int64)))
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ok = keys[order], np.concatenate((self.pair_ok, np.array(list(self.fresh.values()), bool)))[order]
        self.fresh = {}

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, length) codes -> pieces from the last one backwards, and how many; -2 for an unknown character."""
        n_words, n = words.shape
        with np.errstate(over="ignore"):
            powers, back_powers = textnum._powers(textnum._BASE, n + 1), textnum._powers(textnum._BASE_INV, n + 1)
            sums = np.zeros((n_words, n + 1), np.uint64)
            np.cumsum((words.astype(np.uint64) + np.uint64(1)) * powers[:n], axis=1, out=sums[:, 1:])
        best = np.full((n_words, n + 1), -np.inf)
        best[:, 0] = 0
        piece, length = np.full((n_words, n + 1), -1, np.int64), np.zeros((n_words, n + 1), np.int64)
        for end in range(1, n + 1):
            for size in range(min(end, self.longest), 0, -1):
                begin = end - size
                with np.errstate(over="ignore"):
                    key = textnum.mix((sums[:, end] - sums[:, begin]) * back_powers[begin])
                at = np.minimum(np.searchsorted(self.piece_keys, key), len(self.piece_keys) - 1)
                found = np.where(self.piece_keys[at] == key, self.piece_ids[at], -2 if size == 1 else -1)
                # by merges a position is reached in one way only, so what is reached is done
                rows = np.flatnonzero((found != -1) & (best[:, begin] > -np.inf) & ((best[:, end] == -np.inf) if self.merges else True))
                if not len(rows):
                    continue
                token = found[rows]
                if self.merges:
                    before = piece[rows, begin]
                    check = (token >= 0) & (before >= -1)
                    ok = np.ones(len(rows), bool)
                    ok[check] = self._stable(before[check], token[check])
                    # behind an unknown character a piece only has to be stable itself
                    alone = (token >= 0) & (before == -2)
                    ok[alone] = self._stable(np.full(int(alone.sum()), -1), token[alone])
                    value = np.where(ok, size / 1e6, -np.inf)
                else:
                    value = best[rows, begin] + np.where(token >= 0, np.array(self.score)[np.maximum(token, 0)], self.unknown_score)
                better = value > best[rows, end]
                rows = rows[better]
                best[rows, end], piece[rows, end], length[rows, end] = value[better], token[better], size
        out, count, place = np.full((n_words, n), -1, np.int64), np.zeros(n_words, np.int64), np.full(n_words, n)
        for k in range(n):
            on = np.flatnonzero(place > 0)
            if not len(on):
                break
            out[on, k] = piece[on, place[on]]
            place[on] -= length[on, place[on]]
            count[on] += 1
        return out, count

    def _encode(self, part: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._file_fresh()
        at, n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        found: list[np.ndarray] = []
        used = 0
        for size in np.unique(length).tolist():
            chosen = np.flatnonzero(length == size)
            step = max(1, (1 << 20) // size)
            for k in range(0, len(chosen), step):
                which = chosen[k : k + step]
                words = part[start[which][:, None] + np.arange(size)]
                back, count = self.viterbi(words)
                flip = np.maximum(count[:, None] - 1 - np.arange(size), 0)
                ids = np.take_along_axis(back, flip, 1)
                live = np.arange(size) < count[:, None]
                flat, counts = ids[live], count
                odd = np.flatnonzero(flat == -2)
                if len(odd):  # characters without a piece, as bytes
                    owner = np.repeat(np.arange(len(which)), count)
                    widths = np.where(flat == -2, 1, np.array([len(self.text[i]) if i >= 0 else 1 for i in flat.tolist()]))
                    begins = np.cumsum(widths) - widths
                    code = words.ravel()[begins[odd]]
                    spelled = [[self.byte[x] for x in chr(c).encode()] if self.byte else [self.unknown] for c in code.tolist()]
                    grow = np.ones(len(flat), np.int64)
                    grow[odd] = [len(s) for s in spelled]
                    counts = np.bincount(owner, grow, len(which)).astype(np.int64)
                    flat = np.repeat(flat, grow)
                    flat[flat == -2] = np.array([x for s in spelled for x in s], np.int64)
                at[which], n[which] = used + np.cumsum(counts) - counts, counts
                found.append(flat)
                used += len(flat)
        return (np.concatenate(found) if found else np.zeros(0, np.int64)), at, n

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of rows with ``counts`` ids each; bytes that are no UTF-8 become U+FFFD."""
        width = self.raw_n[ids]
        data = textnum.take_stretches(self.raw, self.raw_at[ids], width)
        ends = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(counts)))]
        begins, ends = ends[:-1].copy(), ends[1:]
        if self.dummy:  # the blank that encoding put first
            full = ends > begins
            first = begins[full]
            begins[full] += data[first] == 32
        keep = textnum.take_stretches(data, begins, ends - begins)
        at = np.concatenate(([0], np.cumsum(ends - begins)))
        raw = keep.tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            return pa.array([raw[a:b].decode(errors="replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
        return pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.string())


def encode(text: Column, model: str | None = None) -> Column:
    """The ids of each whole text as ``array<int>``."""
    path = model or default_model()

    def ids_of(column: pa.Array) -> pa.Array:
        parts, counts = [np.zeros(0, np.int32)], np.zeros(len(column), np.int64)
        for lo, hi, ids, n in encoder(path).encode(column):
            parts.append(ids.astype(np.int32))
            counts[lo:hi] += n
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(np.concatenate(parts)))

    ids_of.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(ids_of, T.ArrayType(T.IntegerType()))(text)


def decode(ids: Column, model: str | None = None) -> Column:
    """The text of each list of ids; null stays null."""
    path = model or default_model()

    def text_of(column: pa.Array) -> pa.Array:
        n = np.nan_to_num(np.asarray(column.value_lengths().fill_null(0)), nan=0).astype(np.int64)
        texts = encoder(path).decode(np.asarray(column.flatten()).astype(np.int64), n)
        return pc.if_else(column.is_valid(), texts, pa.scalar(None, pa.string()))

    text_of.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(text_of, "string")(ids)


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, round_trip``: each whole text encoded and decoded again.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit numbers.
    """
    path = model or default_model()
    rows = columns_of(df, doc_id=doc_id, text=text)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in batches:
            column = batch.column(1).fill_null("")
            for lo, hi, ids, n in textnum.whole_rows(codec.encode(column)):
                wide, ends = ids.astype("<u4"), np.cumsum(n).tolist()
                crc = [zlib.crc32(wide[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                same = pc.equal(codec.decode(ids.astype(np.int64), n), column.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), same], names=schema.names)

    return rows.mapInArrow(run, schema)
