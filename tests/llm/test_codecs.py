"""Tokenizers over columns against their own libraries."""

import random

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import bpe, piece_codec, textnum

PARTS = [*"ab é \n\t  ' \u0085s1!_😀ß\r☃", "<|endoftext|>", " the", "　", "  ", "'s", "\n\n", "tion", "<0x0A>", "<s>", "▁"]


def texts(n=300):
    random.seed(4)
    return ["".join(random.choice(PARTS) for _ in range(random.randint(0, 60))) for _ in range(n)] + [None, "", " ", "x" * 300 + " " + "y " * 200, "\n"]


def ids_of(codec, column, limit, monkeypatch):
    monkeypatch.setattr(textnum.segments, "__defaults__", (limit, textnum.SPACE, None))
    out = [[] for _ in range(len(column))]
    for lo, hi, ids, n in codec.encode(column):
        for i, x in zip(range(lo, hi), np.split(ids, np.cumsum(n)[:-1]), strict=True):
            out[i] += x.tolist()
    return out


@pytest.mark.parametrize("limit", [50, 1 << 19])
def test_bpe(limit, monkeypatch):
    from tokenizers import Tokenizer

    own, column = Tokenizer.from_file(bpe.default_tokenizer()), pa.array(texts(), pa.string())
    codec = bpe.ColumnEncoder(bpe.default_tokenizer())
    want = [own.encode(x or "", add_special_tokens=False).ids for x in column.to_pylist()]
    assert ids_of(codec, column, limit, monkeypatch) == want
    assert codec.lengths(column).tolist() == [len(w) for w in want]


def test_bpe_forgets(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "MOST", 40)
    own, column = Tokenizer.from_file(bpe.default_tokenizer()), pa.array([f"w{i} x{i % 7}" for i in range(30)])
    codec = bpe.ColumnEncoder(bpe.default_tokenizer())
    for _ in range(3):
        assert ids_of(codec, column, 60, monkeypatch) == [own.encode(x, add_special_tokens=False).ids for x in column.to_pylist()]


def test_pieces(monkeypatch):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    codec, column = piece_codec.encoder(piece_codec.default_model()), pa.array(texts(), pa.string())
    want = [own.encode(x or "") for x in column.to_pylist()]
    got = ids_of(codec, column, 1 << 19, monkeypatch)
    assert got == want
    back = codec.decode(np.array([i for g in got for i in g], np.int64), np.array([len(g) for g in got]))
    assert back.to_pylist() == [(x or "").replace("▁", " ") for x in column.to_pylist()]


def test_unigram_viterbi_is_the_best_way():
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.trainer_spec.model_type = 1
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = True
    random.seed(6)
    pieces = {"<unk>": 0.0, "▁": -2.0} | {p: -random.uniform(1, 6) for p in ("a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "cab", "bca")}
    for p, s in pieces.items():
        model.pieces.add(piece=p, score=s, type=2 if p == "<unk>" else 1)
    codec, names = piece_codec.PieceEncoder(model.SerializeToString()), list(pieces)

    def best(word):
        ways = [(0.0, [])] + [None] * len(word)
        for e in range(1, len(word) + 1):
            found = [(ways[b][0] + pieces[word[b:e]], [*ways[b][1], word[b:e]]) for b in range(e) if word[b:e] in pieces and ways[b]]
            ways[e] = max(found) if found else None
        return ways[-1][1]

    for word in ("abcabc", "aabbcc", "bcabca", "cabab"):
        ids = next(codec.encode(pa.array([word])))[2]
        assert [names[i] for i in ids] == best("▁" + word)


def test_digest_and_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "Hello  wörld ☃", "x"), (1, "Hello  wörld ☃", "x"), (None, None, None)], "doc_id long, text string, Text_ string")
    rows = piece_codec.digest(df).collect()
    assert len(rows) == 3 and all(r["round_trip"] for r in rows) and {r["n_pieces"] for r in rows if r["doc_id"] is None} == {0}
    back = df.select("text", piece_codec.decode(piece_codec.encode(F.col("text"))).alias("b")).collect()
    assert all((r["text"] or "") == r["b"] for r in back)
    assert piece_codec.digest(df.where("false")).count() == 0


def test_long_text_without_blanks():
    import time

    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    random.seed(17)
    rows = ["".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "".join(chr(random.randint(0x4E00, 0x9FA5)) for _ in range(20_000)), "".join(random.choice(["tion", "the", "é", "ß", "x9"]) for _ in range(9_000))]
    codec, began = piece_codec.encoder(piece_codec.default_model()), time.time()
    for x in rows:
        assert np.concatenate([ids for *_, ids, _ in codec.encode(pa.array([x]))]).tolist() == own.encode(x)
    assert time.time() - began < 30
