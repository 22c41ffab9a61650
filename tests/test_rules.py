"""Normalisation, context, vetoes, linking and training rows against plain versions."""

import random
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.functions import scorers
from spanloom.functions import text as t
from spanloom.operators import context, evaluate, generators, intervals, linking, occurrences, sampling, sequences, vetoes


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"]


def plain_fold(text):
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").casefold()


def test_folding_over_all_characters(spark):
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4]
    rows = [(i, "".join(chars[i : i + 64])) for i in range(0, len(chars), 64)]
    got = {r["i"]: r["x"] for r in spark.createDataFrame(rows, "i int, s string").select("i", t.fold_accents(F.col("s")).alias("x")).collect()}
    same = sum(plain_fold(x) == got[i] for i, x in rows)
    # letters newer than the machine's tables, and a few whose small form has no fold, may differ
    assert same >= 0.97 * len(rows)
    for x in ("й ё ά ß", "Žluťoučký KŮŇ", "Ἀθῆναι ΜΆΪΟΣ", "ﬁn ŉ", "Tiếng Việt ệ ộ", "İ ı"):
        assert one(spark, t.fold_accents(F.col("s")), s=x) == plain_fold(x)
    assert one(spark, t.fold_all(F.col("s")), s="Đà Nẵng Йод") == "Da Nang Иод"


def test_phrases_that_overlap_themselves(spark):
    random.seed(19)
    phrases = ["a a", "that", "ab", "a-a", "a", "ba b"]
    rows = [(i, "".join(random.choice(["a", "b", " ", "-", "that", "İ"]) for _ in range(random.randint(0, 25)))) for i in range(300)]
    want = set()
    for i, x in rows:
        low = x.replace("İ", "i").lower()
        for p in phrases:
            at = low.find(p)
            while at >= 0:
                if not (at and (low[at - 1].isalnum())) and not (at + len(p) < len(low) and low[at + len(p)].isalnum()):
                    want.add((i, p, at, at + len(p)))
                at = low.find(p, at + len(p))
    got = occurrences.phrase_occurrences(spark.createDataFrame(rows, "doc_id int, text string"), phrases).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_composing(spark):
    random.seed(6)
    words = ["tiếng việt ệ ộ ữ", "Ångström é à ö ñ", "ά ή ὕ", "й ё", "a\u0323\u0302 q\u0301", "plain"]
    rows = [(i, unicodedata.normalize(random.choice(["NFC", "NFD"]), random.choice(words) + " " + random.choice(words))) for i in range(60)]
    got = {r["i"]: r["x"] for r in spark.createDataFrame(rows, "i int, s string").select("i", t.compose(F.col("s")).alias("x")).collect()}
    assert all(got[i] == unicodedata.normalize("NFC", x) for i, x in rows)
    assert one(spark, t.normalize_conservative(F.col("s")), s="Cafe\u0301-BAR, x") == "café bar x"


@pytest.mark.parametrize(("text", "want"), [("x typ ii", "x tip 2"), ("Type 1, tuyp2", "tip 1 tip 2"), ("tip i b", "tip 1 b"), ("tip1", "tip1"), ("Mạn tính, manh", "man manh"), ("typewriter", "typewriter")])
def test_aggressive(spark, text, want):
    assert one(spark, t.normalize_aggressive(F.col("s")), s=text) == want


def test_cues(spark):
    random.seed(7)
    words = ["no", "not", "only", "ever", "aunt", "auntie", "the", "family", "doctor", "he", " ", "  "]
    rows = [(i, " ".join(random.choice(words) for _ in range(random.randint(0, 9)))) for i in range(400)]

    def plain_any(w, cues, exceptions):
        return any(w.startswith(c, i) and not any(w[i + len(c) :].lstrip().startswith(e) for e in exceptions) for c in cues for i in range(len(w)))

    def plain_last(w, cues, exceptions):
        return any((i := w.rfind(c)) >= 0 and not any(w[i + len(c) :].lstrip().startswith(e) for e in exceptions) for c in cues)

    def plain_subject(w, subjects, masked, blockers):
        for m in masked:
            w = w.replace(m, " " * len(m))
        best = max((i for s in subjects for i in range(len(w)) if w.startswith(s, i) and not (i and w[i - 1].isalnum()) and not (i + len(s) < len(w) and w[i + len(s)].isalnum())), default=None)
        return best is not None and not any(b in w[best:] for b in blockers)

    df = spark.createDataFrame(rows, "i int, w string").select(
        "i", context.any_cue(F.col("w"), ["no", "not"], ["only", "the"]).alias("a"), context.last_cue_scope(F.col("w"), ["no", "not"], ["only", "the"]).alias("l"),
        context.last_subject(F.col("w"), ["aunt", "family"], ["family doctor"], ["he"]).alias("s"),
    )
    got = {r["i"]: (r["a"], r["l"], r["s"]) for r in df.collect()}
    for i, w in rows:
        assert got[i] == (plain_any(w, ["no", "not"], ["only", "the"]), plain_last(w, ["no", "not"], ["only", "the"]), plain_subject(w, ["aunt", "family"], ["family doctor"], ["he"])), w


def test_vetoes(spark):
    def why(kind, text, before="", after=""):
        body = before + text + after
        asks = vetoes.asks_about_self(F.col("b"), F.lit(len(before)), F.lit(len(before) + len(text)))
        return one(spark, vetoes.veto(F.col("k"), F.col("x"), asks), b=body, k=kind, x=text)

    assert why("CHẨN_ĐOÁN", "đang  mang thai") == "state" and why("TRIỆU_CHỨNG", "mang thai") is None
    assert why("THUỐC", " ***a* ") == "masked" and why("THUỐC", "**aaa") is None and why("THUỐC", "  ") is None
    assert why("TÊN_XÉT_NGHIỆM", "Xét  nghiệm") == "generic" and why("TÊN_XÉT_NGHIỆM", "xét nghiệm máu") is None
    assert why("CHẨN_ĐOÁN", "cúm", "Em có phải bị ", " không ạ?") == "question"
    assert why("CHẨN_ĐOÁN", "cúm", "Bệnh ", " có lây không?") is None
    sure = vetoes.confirmed_drop(F.col("k"), F.col("x"), F.col("b"), F.col("s"), F.col("e"), F.col("g"))
    assert one(spark, sure, k="CHẨN_ĐOÁN", x="Có  thai", b="Có  thai", s=0, e=8, g="") == "state"
    assert one(spark, sure, k="CHẨN_ĐOÁN", x="đang có thai", b="đang có thai", s=0, e=12, g="") is None
    assert one(spark, sure, k="TÊN_XÉT_NGHIỆM", x="chẩn đoán hình ảnh", b="chẩn đoán hình ảnh", s=0, e=18, g="EHR_LAB") is None
    assert one(spark, sure, k="THUỐC", x="ho", b="hoa", s=0, e=2, g="") == "inside" and one(spark, sure, k="THUỐC", x="ho", b="ho a", s=0, e=2, g="") is None


def test_label_repair(spark):
    rules = vetoes.LabelRules(
        headers=["vital signs"], events=["admitted"], normal=["alert"], readings=["pulse"], reactions=["allergy"], habits=(["smokes", "uses"], ["tobacco"]), histories=["history of"],
        procedures=["removal of", "removal"], disorders=["tumour"], reasons=["for"], units=["mmHg", "%"],
    )
    cases = [
        ("s", "Vital  signs", None), ("d", "admitted today", None), ("s", "alert and well", None), ("d", "alert and well", ("kept", "d", 10, "alert and well")),
        ("s", "Pulse", ("reading", "t", 10, "Pulse")), ("s", "pulse fast", ("kept", "s", 10, "pulse fast")), ("d", "allergy to x", ("symptom", "s", 10, "allergy to x")), ("d", "smokes much tobacco", ("symptom", "s", 10, "smokes much tobacco")),
        ("d", "history of gout", ("history", "d", 21, "gout")), ("t", "history of gout", ("kept", "t", 10, "history of gout")), ("d", "history of ", ("kept", "d", 10, "history of ")),
        ("d", "removal of tumour x", ("core", "d", 21, "tumour x")), ("d", "removal of tooth for pain", ("core", "d", 31, "pain")), ("d", "removal of tooth", None), ("s", "pressure 120 mmHg", None), ("d", "pressure 120 mmHg", ("kept", "d", 10, "pressure 120 mmHg")),
        ("d", "history of removal of tumour", ("core", "d", 32, "tumour")),
    ]
    spans = spark.createDataFrame([(1, i, 10, 10 + len(x), k, x) for i, (k, x, _) in enumerate(cases)], "doc_id long, ord int, start int, end int, type string, text string")
    got = {r["ord"]: (r["action"], r["type"], r["start"], r["text"]) for r in vetoes.repaired(spans, rules, "s", "t", "d", ["s", "d"]).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases) if want}


def test_reclassified(spark):
    kind = vetoes.reclassified(F.col("k"), F.col("x"), F.col("c"), F.col("l"), ["cyst"], ["sinus rhythm", "block"], ["ecg", "holter"], ["shows"], ["cramp"], ("LAB",), "s", "r", "d")

    def of(k, x, c="", line=""):
        return one(spark, kind, k=k, x=x, c=c, l=line)

    assert of("d", "Cyst", "LAB") == "r" and of("d", "cyst") == "d" and of("d", "cyst", "", "scan shows a ") == "r" and of("s", "cyst", "LAB") == "s"
    assert of("s", "sinus rhythm fast", "", "ECG: ") == "r" and of("s", "sinus rhythm, fast", "", "ECG: ") == "s" and of("d", "block", "", "blocks ") == "d" and of("d", "cramp") == "s"


def test_lexicon_repair(spark):
    random.seed(8)
    text = "".join(random.choice("ab ") for _ in range(400))
    lexicon = [("n", "ab a", 3), ("n", "a b", 3), ("n", "ba", 1), ("m", "aa", 9), ("n", "ab", 30)]
    rows = []
    for i in range(80):
        s = random.randrange(390)
        rows.append((1, i, s, s + random.randint(1, 9), random.choice("nm")))
    want = {}
    for _, i, s, e, kind in rows:
        best = None
        for k, (lk, phrase, n) in enumerate(lexicon):
            lo, hi = max(0, s - 5), min(len(text), e + 5)
            at = text.find(phrase, lo, hi) if lk == kind else -1
            while at >= 0:
                o = min(e, at + len(phrase)) - max(s, at)
                r = o / min(e - s, len(phrase))
                rank = (r, o, -abs(s - at) - abs(e - at - len(phrase)), min(len(phrase) - (e - s), 32) + n)
                if o > 0 and r >= 0.5 and (best is None or rank > best[0]):
                    best = (rank, at, at + len(phrase))
                at = text.find(phrase, at + 1, hi)
        want[i] = best[1:] if best else (s, e)
    df = spark.createDataFrame(rows, "doc_id long, ord int, start int, end int, type string")
    lex = spark.createDataFrame([(*x, k) for k, x in enumerate(lexicon)], "type string, phrase string, n int, ord int")
    got = {r["ord"]: (r["start"], r["end"]) for r in intervals.lexicon_repair(df, spark.createDataFrame([(1, text)], "doc_id long, text string"), lex, 5).collect()}
    assert got == want and any(want[r[1]] != r[2:4] for r in rows)


def test_fragments_and_equal_spans(spark):
    text = "the red  bolt, x red bolt gear"
    s = spark.createDataFrame([(1, 1, 4, 7, "n", "red", ["a"]), (1, 2, 9, 13, "n", "bolt", ["b"]), (1, 3, 17, 20, "n", "red", []), (1, 4, 21, 25, "n", "bolt", []), (1, 5, 26, 30, "m", "gear", [])], "doc_id long, ord long, start int, end int, type string, text string, flags array<string>")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = intervals.merge_fragments(s, docs, [("n", "red  bolt"), ("n", "x red bolt gea"), ("n", "red bolt")]).orderBy("start").collect()
    assert [(r["start"], r["end"], r["text"], r["flags"]) for r in got] == [(4, 13, "red  bolt", ["a", "b"]), (15, 29, "x red bolt gea", []), (26, 30, "gear", [])]
    twice = spark.createDataFrame([(1, 1, 0, 5, "n", 1.0, ["x"]), (1, 2, 0, 5, "n", 3.0, ["y"]), (1, 3, 2, 9, "n", 2.0, [])], "doc_id long, ord long, start int, end int, type string, score double, flags array<string>")
    kept = intervals.resolve_by_score(twice).collect()
    assert [(r["start"], r["end"], r["score"], sorted(r["flags"])) for r in kept] == [(0, 5, 3.0, ["x", "y"])]


def test_segmenting(spark):
    text = "red  bolt of\nthe Big red bolt"
    got = generators.segmented(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), ["red bolt", "of the"]).orderBy("doc_id").collect()
    assert got[0]["segmented"] == "red_bolt of\nthe Big red_bolt" and len(got[0]["seg2raw"]) == len(got[0]["segmented"]) and got[1]["segmented"] == ""
    assert all(p is None or text[p] == c for p, c in zip(got[0]["seg2raw"], got[0]["segmented"], strict=True))
    df = spark.createDataFrame([(got[0]["seg2raw"],)], "m array<int>")
    assert tuple(df.select(generators.raw_places(F.col("m"), F.lit(0), F.lit(8)).alias("x")).first()["x"]) == (0, 9)
    assert df.select(generators.raw_places(F.col("m"), F.lit(3), F.lit(4)).alias("x")).first()["x"] is None


def test_cascade(spark):
    entries = spark.createDataFrame(
        [(1, "A", ["x"], None, 0, False, True), (2, "A5", ["x"], 5.0, 1, False, False), (3, "A9", ["x"], 9.0, 1, False, False), (4, "B5", ["y", "z"], 5.0, 0, True, False), (5, "C", ["w", "v", "u"], None, 0, False, True)],
        "entry_id long, concept string, tokens array<string>, value double, prio int, suppressed boolean, bare boolean",
    )
    asked = [(1, ["x"], 5.0), (2, ["x"], 8.0), (3, ["x"], None), (4, ["y"], 5.0), (5, ["nsaid"], None), (6, [], None), (7, ["q"], 1.0), (8, ["w", "v"], 3.0)]
    queries = spark.createDataFrame(asked, "qid long, tokens array<string>, value double")
    dense = spark.createDataFrame([(i, 1, 99, "D") for i in range(1, 9)], "qid long, rank int, entry_id long, concept string")
    got = {(r["qid"], r["rank"]): (r["entry_id"], r["tier"]) for r in linking.cascade(queries, entries, ["nsaid"], dense).collect()}
    assert got == {(1, 1): (2, "dosed"), (2, 1): (3, "nearest"), (3, 1): (1, "bare"), (4, 1): (4, "dosed"), (6, 1): (99, "dense"), (7, 1): (99, "dense"), (8, 1): (99, "dense")}
    bare = {r["qid"]: (r["entry_id"], r["tier"]) for r in linking.cascade(queries, entries, ["nsaid"], None, nearest=False).collect()}
    assert bare[2] == (1, "bare") and 6 not in bare


def test_lexical_penalties(spark):
    words = lambda *ws: F.array(*[F.lit(w) for w in ws])
    df = spark.range(1)
    score = lambda *a, **k: round(df.select(linking.lexical(*a, **k).alias("x")).first()["x"], 9)
    assert score(words("a", "b"), words("a")) == 0.5 and score(words("a"), words("a", "c")) == 0.6
    assert score(words("a"), words("a", "tablet"), variants=["tablet"]) == 0.92 and score(words("a"), words("a", "oral"), neutral=["oral"]) == 1.0
    assert score(words("a", "tablet"), words("a"), forms=["tablet"], bare=True) == 1.0 and score(words("tablet"), words("tablet"), forms=["tablet"], bare=True) == 1.0


def test_guided(spark):
    ranked_schema = "qid long, concept string, rank int, score double, kind string, same boolean, literal boolean, named boolean, brand_written boolean, injection boolean, oral boolean, volume double"
    cases = {  # qid: (by mouth, by injection, volumes), candidates, decision
        1: ((False, False, []), [("a", 1.0, "SCDC", True, False, False, False, False, False, None)], ("a", "full")),
        2: ((True, False, []), [("a", 0.96, "SCD", True, True, False, False, False, True, None)], ("a", "by mouth")),
        3: ((False, False, []), [("a", 0.8, "SBD", True, False, True, False, False, False, None)], ("a", "brand")),
        4: ((False, True, []), [("a", 1.0, "SCDC", True, False, False, False, False, False, None), ("b", 0.97, "SCD", True, False, False, False, True, False, None)], ("b", "injection")),
        5: ((False, False, [500.0]), [("a", 0.9, "SCDC", True, False, False, False, False, False, None), ("b", 0.5, "SCD", True, False, False, False, True, False, 500.0)], ("b", "volume")),
        6: ((False, False, []), [("a", 1.0, "SBDC", True, False, False, False, False, False, None), ("b", 0.97, "SCD", True, False, False, False, True, False, None)], ("b", "only injection")),
        7: ((False, False, []), [("a", 1.0, "SCDC", False, False, False, False, False, False, None)], ("f", "fallback")),
        8: ((False, True, []), [("a", 1.0, "SCD", True, True, False, False, False, False, None)], ("f", "fallback")),
    }
    queries = spark.createDataFrame([(q, *a) for q, (a, _, _) in cases.items()], "qid long, by_mouth boolean, by_injection boolean, volumes array<double>")
    ranked = spark.createDataFrame([(q, c[0], i + 1, *c[1:]) for q, (_, cs, _) in cases.items() for i, c in enumerate(cs)], ranked_schema)
    fallback = spark.createDataFrame([(q, "f") for q in cases], "qid long, concept string")
    assert {r["qid"]: (r["concept"], r["why"]) for r in linking.guided(queries, ranked, fallback).collect()} == {q: w for q, (_, _, w) in cases.items()}


def test_conservative_brands(spark):
    ranked = spark.createDataFrame([(1, "a", 0.5, 1, False), (1, "b", 0.495, 2, False), (2, "a", 0.2, 1, True), (3, "a", 0.2, 1, False), (4, "a", 0.9, 1, True)], "qid long, concept string, score double, rank int, contained boolean")
    brands = spark.createDataFrame([(4, "z", 0.3, True), (3, "y", 0.1, True), (1, "x", 0.9, False)], "qid long, concept string, score double, fits boolean")
    assert {(r["qid"], r["concept"]) for r in linking.conservative(ranked, brands=brands).collect()} == {(2, "a"), (4, "z")}


def test_codes(spark):
    raw = spark.createDataFrame([("a10", "Gout", None), ("A10.1†", "gout acute", None), ("A109", "Gout, không xác định", None), ("B20", "Flu", None), ("b20", "Influenza", None), (None, "x", None)], "code string, name string, parent string")
    nodes = linking.code_nodes(raw)
    got = {r["code"]: (r["parent"], r["children"], r["level"]) for r in nodes.collect()}
    assert got == {"A10": (None, ["A10.1", "A10.9"], "category"), "A10.1": ("A10", [], "disease"), "A10.9": ("A10", [], "disease"), "B20": (None, [], "category")}
    aliases = spark.createDataFrame([("the grip", "B20", 0.9), ("ghost", "Z99", 1.0)], "alias string, code string, confidence double")
    fuzzy = spark.createDataFrame([(7, "A10.1", 0.88), (2, "B20", 0.7)], "qid long, code string, confidence double")
    texts = ["see A10.1 now", "The Grip", "không có the grip", "GOUT", "gout unspecified", "ghost", "gowt", None]
    queries = spark.createDataFrame([(i + 1, x, i == 2) for i, x in enumerate(texts)], "qid long, text string, negated boolean")
    matched = linking.match_codes(queries, nodes, aliases, fuzzy)
    assert {r["qid"]: (r["code"], r["confidence"], r["how"]) for r in matched.collect()} == {
        1: ("A10.1", 1.0, "code"), 2: ("B20", 0.9, "alias"), 3: (None, 0.0, "negated"), 4: ("A10", 1.0, "name"), 5: ("A10.9", 0.95, "backed"), 6: (None, 0.0, "none"), 7: ("A10.1", 0.88, "fuzzy"), 8: (None, 0.0, "none"),
    }
    candidates = spark.createDataFrame([(6, f"C{k}", k) for k in range(1, 8)] + [(3, "C1", 1)], "qid long, code string, rank int")
    assert {r["qid"]: r["codes"] for r in linking.adapted(matched.where("qid in (2, 3, 6)"), candidates).collect()} == {2: ["B20"], 3: [], 6: ["C1", "C2", "C3", "C4", "C5"]}


def test_dense_search(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 6))
    v[7] = v[3]
    cat = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "code long, vector array<double>")
    asked = cat.where("code % 10 = 3").select(F.col("code").alias("qid"), F.lit(0).alias("view"), "vector")
    got = linking.dense_search(asked, cat, 4, block=7, chunk=2).collect()
    for q in (3, 13, 53):
        order = [i for i in np.lexsort((np.arange(60), -(v @ v[q]))) if i != q][:4]
        assert [r["code"] for r in sorted(got, key=lambda r: r["rank"]) if r["qid"] == q] == order
    found = spark.createDataFrame([(1, 0, "a", 0.9), (1, 1, "a", 0.7), (1, 0, "b", 0.75), (1, 1, "c", 0.5)], "qid long, view int, code string, sim double")
    assert [(r["code"], round(r["sim"], 6)) for r in linking.mean_over_views(found).orderBy("rank").collect()] == [("a", 0.8), ("b", 0.75)]


def test_verifier_rows(spark):
    random.seed(9)
    make = lambda n: [(random.randrange(3), s := random.randrange(30), s + random.randint(1, 6), random.choice("ab"), random.choice("xy")) for _ in range(n)]
    a, b, m = make(60), make(60), make(40)
    a, b, m = sorted(set(a + b[:10])), sorted(set(b)), sorted(set(m))
    want = {(*r, "KEEP", r[1], r[2], 1.0) for r in set(a) & set(b)}
    right, used = [r for r in b if r not in a], set()
    for r in [r for r in a if r not in b]:
        near = [(min(r[2], o[2]) - max(r[1], o[1]), i) for i, o in enumerate(right) if i not in used and o[0] == r[0] and o[3] == r[3] and min(r[2], o[2]) > max(r[1], o[1])]
        if near:
            i = max(near)[1]
            used.add(i)
            want.add((*r, "ADJUST", right[i][1], right[i][2], 0.5))
        else:
            want.add((*r, "DROP", None, None, 0.5))
    want |= {(*r, "KEEP", r[1], r[2], 0.5) for i, r in enumerate(right) if i not in used}
    want |= {(*r, "DROP" if r[1] % 5 == 0 else "REVIEW", None, None, 1.0 if r[1] % 5 == 0 else 0.0) for r in m if r not in a and r not in b}
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, start int, end int, type string, text string")
    got = sampling.verifier_rows(frame(a), frame(b), frame(m), F.when(F.col("start") % 5 == 0, "masked")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_scores(spark):
    items = spark.createDataFrame([(0.5, ["a"], ["a"], ["c"], ["c", "d"], False), (0.0, [], [], [], [], False), (0.0, [], [], ["c"], ["c"], True)], "wer double, flags array<string>, gold_flags array<string>, codes array<string>, gold_codes array<string>, wrong_type boolean")
    r = evaluate.weighted_score(items).first()
    assert [round(x, 9) for x in r] == [round(1.5 / 4, 9), round(2 / 4, 9), round((0.5 * 3 + 1) / (3 + 1 + 2 * 2), 9), round(0.3 * 1.5 / 4 + 0.3 * 0.5 + 0.4 * 2.5 / 8, 9)]
    gold = spark.createDataFrame([(1, "a", 1, 0, 5), (1, "a", 2, 6, 9), (1, "b", 3, 0, 5)], "doc_id long, type string, ord long, start int, end int")
    pred = spark.createDataFrame([(1, "a", 1, 3, 8), (1, "a", 2, 4, 7)], "doc_id long, type string, ord long, start int, end int")
    pairs = intervals.overlapping(gold, pred, ["doc_id", "type"], 4)
    assert {(r["left"], r["right"], r["overlap"]) for r in pairs.collect()} == {(1, 1, 2), (2, 1, 2), (1, 2, 1), (2, 2, 1)}
    matches = evaluate.greedy_matches(pairs.select("doc_id", F.col("left").alias("gold"), F.col("right").alias("pred"), "overlap"))
    s = evaluate.overlap_scores(matches, gold, pred).first()
    assert (s["tp"], s["pred"], s["ref"]) == (2, 2, 3) and abs(s["f1"] - 0.8) < 1e-12 and abs(s["jaccard"] - 2 / 3) < 1e-12


def test_splits_by_hash(spark):
    rows = [(i, "ab"[i % 7 == 0], int(i % 5 == 0)) for i in range(500)] + [(900, "c", 0), (901, None, 1)]
    df = spark.createDataFrame(rows, "k long, g string, y int")
    md5 = lambda k, seed: __import__("hashlib").md5(f"{k}:{seed}".encode()).hexdigest()
    got = {r["k"]: r["subset"] for r in sampling.stratified_split(df, "k", "g", 0.2).collect()}
    kept = {(r["k"]) for r in sampling.cap_group(df, "g", "y", 90, F.col("k")).collect()}
    for g in ("a", "b", "c", None):
        ks = [r for r in rows if r[1] == g]
        want = max(1, round(len(ks) * 0.2)) if len(ks) > 1 else 0
        first = {r[0] for r in sorted(ks, key=lambda r: md5(r[0], 42))[:want]}
        assert {r[0] for r in ks if got[r[0]] == "validation"} == first
        order = sorted(ks, key=lambda r: (-r[2], md5(r[0], 13)))
        assert kept & {r[0] for r in ks} == {r[0] for i, r in enumerate(order) if i < 90 or r[2]}


def test_plug_ins(spark):
    prompts = spark.createDataFrame([(1, "bb"), (2, "a")], "id long, prompt string")
    assert {(r["id"], r["response"]) for r in scorers.generate_texts(prompts, lambda: lambda ps: [p.upper() for p in ps]).collect()} == {(1, "BB"), (2, "A")}

    class Lengths:
        def encode(self, texts):
            return [[float(len(x))] for x in texts]

        def score(self, query, candidates):
            return [float(query == c) for c in candidates]

    df = spark.createDataFrame([("abc", "abc"), (None, "x")], "a string, b string")
    assert [r["v"] for r in df.select(scorers.embed(F.col("a"), Lengths).alias("v")).collect()] == [[3.0], [0.0]]
    assert [r["v"] for r in df.select(scorers.pair_scores(F.col("a"), F.col("b"), Lengths).alias("v")).collect()] == [1.0, 0.0]


def test_chains_as_rows(spark):
    rows = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 2.0]]), (2, [[0.0, 3.0]])], "doc_id long, emissions array<array<double>>")
    got = {r["doc_id"]: r for r in sequences.decode_chain(rows, [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0], [0.0, 0.0]).collect()}
    assert got[1]["path"] == [0, 1] and got[2]["path"] == [1]
    assert abs(got[2]["log_share"] - (3 - np.log(np.exp(3) + 1))) < 1e-9 and isinstance(got[1]["log_share"], float) and pd.notna(got[1]["log_share"])
