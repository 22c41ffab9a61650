"""Exact byte-level BPE over whole columns: every distinct stretch between blanks is encoded once.

The pre-tokeniser never joins what precedes white space with that white space, so a text can be cut
there and the parts encoded one by one with the same ids. The parts repeat a lot; each worker keeps
the ids of the parts that it has seen, in sorted arrays that are searched for whole batches at once.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa

from . import textnum

#: Parts longer than this are encoded without being remembered.
LONGEST = 64
#: Remembered parts; beyond it a worker begins anew, so its memory is bounded.
MOST = 3_000_000
SPECIAL = b"<|endoftext|>"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_KEPT: dict[str, "ColumnEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> "ColumnEncoder":
    """This worker's encoder for the tokenizer file, made at first use."""
    if path not in _KEPT:
        _KEPT[path] = ColumnEncoder(path)
    return _KEPT[path]


class CachedEncoder:
    """Encodes parts of texts one by one and remembers what it has seen.

    A subclass says where parts begin (``_starts``) and encodes new ones (``_encode``).
    """

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint16)
        self.used = 0

    def _learn(self, keys: np.ndarray, part: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        if len(self.keys) + len(keys) > MOST:
            self.forget()
        ids, at, n = self._encode(part, start, length)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint16)))
        self.ids[self.used : self.used + len(ids)] = ids
        order = np.argsort(keys)
        put = np.searchsorted(self.keys, keys[order])
        self.keys, self.at, self.n = np.insert(self.keys, put, keys[order]), np.insert(self.at, put, self.used + at[order]), np.insert(self.n, put, n[order].astype(np.int32))
        self.used += len(ids)

    def _known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return where, np.zeros(len(keys), bool)
        return where, self.keys[np.minimum(where, len(self.keys) - 1)] == keys

    def segment(self, part: np.ndarray, cuts: np.ndarray, want_ids: bool) -> tuple[np.ndarray | None, np.ndarray]:
        """Ids of all rows that begin at ``cuts`` in the segment (all together), and each row's number."""
        if not len(part):
            return np.zeros(0, np.uint16), np.zeros(len(cuts) - 1, np.int64)
        start = self._starts(part, cuts)
        end = np.append(start[1:], len(part))
        keys = textnum.hash_stretches(part, start, end)
        short = end - start <= LONGEST
        distinct, first, back = textnum.distinct(keys[short])
        first = np.flatnonzero(short)[first]
        where, known = self._known(distinct)
        while not known.all():  # twice where it begins anew
            new = first[~known]
            self._learn(distinct[~known], part, start[new], end[new] - start[new])
            where, known = self._known(distinct)
        n = np.zeros(len(start), np.int64)
        n[short] = self.n[where][back]
        long_ids = {}
        for i in np.flatnonzero(~short).tolist():
            long_ids[i] = self._encode(part, start[i : i + 1], end[i : i + 1] - start[i : i + 1])[0]
            n[i] = len(long_ids[i])
        bounds = np.searchsorted(start, cuts)
        total = np.concatenate(([0], np.cumsum(n)))
        counts = total[bounds[1:]] - total[bounds[:-1]]
        if not want_ids:
            return None, counts
        source = np.zeros(len(start), np.int64)
        source[short] = self.at[where][back]
        ids = self.ids[np.arange(total[-1]) + np.repeat(np.where(short, source - total[:-1], -total[:-1]), n)]
        for i, x in long_ids.items():
            ids[total[i] : total[i + 1]] = x
        return ids, counts

    def lengths(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each text; null counts as empty."""
        out = np.zeros(len(column), np.int64)
        for lo, hi, part, cuts in self._parts(column):
            out[lo:hi] += self.segment(part, cuts, False)[1]
        return out

    def encode(self, column: pa.Array):
        """Yields for each segment: from row, to row, ids of these rows, number in each. Long rows come in several."""
        for lo, hi, part, cuts in self._parts(column):
            ids, counts = self.segment(part, cuts, True)
            yield lo, hi, ids, counts

    def _parts(self, column: pa.Array):
        """Segments of the column: from row, to row, the bytes, where rows begin in them and the end."""
        data, offsets = textnum.buffers(column)
        for a, b, lo, hi in textnum.segments(data, offsets):
            yield lo, hi, data[a:b], np.clip(offsets[lo : hi + 1] - a, 0, b - a)


class ColumnEncoder(CachedEncoder):
    """Ids as the file's own library gives them for each text, without added special tokens."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        vocab = json.loads(self.exact.to_str())["model"]["vocab"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if all(c in of for c in token) and token.encode() != SPECIAL}
        self.core = tiktoken.Encoding("columns", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)
        self.forget()

    def _starts(self, part: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        space = textnum.SPACE[part]
        begins = np.zeros(len(part), bool)
        begins[1:] = space[1:] & ~space[:-1]
        # white space beyond ASCII ends in these bytes; no cut after it
        odd = np.flatnonzero(begins[2:] & np.isin(part[:-2], (0x9A, 0x80, 0x81))) + 2
        begins[odd] = False
        odd = np.flatnonzero(begins[2:] & (part[:-2] == 0xC2) & ((part[1:-1] == 0x85) | (part[1:-1] == 0xA0))) + 2
        begins[odd] = False
        full = np.diff(cuts) > 0
        begins[cuts[:-1][full]] = True
        return np.flatnonzero(begins)

    def _encode(self, part: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the given parts in any order; for each part, where its ids begin there and how many they are."""
        at, n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        found: list[np.ndarray] = []
        used = 0
        # parts from white space to some other sign encode alike when they stand one behind the other
        last, before = part[start + length - 1], part[start + np.maximum(length - 2, 0)]
        plain = textnum.SPACE[part[start]] & ~textnum.SPACE[last] & ~((last > 127) & (np.isin(before, (0x80, 0x81, 0x9A)) | (before == 0xC2)))
        if SPECIAL in part.tobytes():
            plain[:] = False
        some = np.flatnonzero(plain)
        for k in range(0, len(some), 1 << 15):
            i = some[k : k + (1 << 15)]
            ids = np.array(self.core.encode_ordinary(textnum.take_stretches(part, start[i], length[i]).tobytes().decode()), np.int64)
            cut = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(length[i])) + 1
            n[i] = np.diff(cut, prepend=0)
            at[i] = used + cut - n[i]
            found.append(ids)
            used += len(ids)
        for i in np.flatnonzero(~plain).tolist():
            raw = part[start[i] : start[i] + length[i]].tobytes()
            text = raw.decode()
            ids = np.array(self.exact.encode(text, add_special_tokens=False).ids if SPECIAL in raw else self.core.encode_ordinary(text), np.int64)
            at[i], n[i] = used, len(ids)
            found.append(ids)
            used += len(ids)
        return (np.concatenate(found) if found else np.zeros(0, np.int64)), at, n
