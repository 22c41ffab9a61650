"""Operators that SQL can't express, against plain loops; edge cases of the others."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import scorers
from spanloom.functions import text as t
from spanloom.operators import evaluate, generators, intervals, linking, occurrences, sequences, validate
from spanloom.sources import readers, writers


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def random_spans(spark):
    random.seed(5)
    rows = []
    for i in range(300):
        s = random.randint(0, 60)
        rows.append((i % 5, i, s, s + random.randint(1, 12), random.choice("abc"), float(random.randint(0, 4))))
    return rows, spark.createDataFrame(rows, "doc_id long, ord long, start int, end int, type string, score double")


def greedy(rows, same_type):
    kept = []
    for r in sorted(rows, key=lambda r: (r[2] - r[3], r[1])):
        if not any(k[0] == r[0] and (not same_type or k[4] == r[4]) and k[2] < r[3] and r[2] < k[3] for k in kept):
            kept.append(r)
    return {r[1] for r in kept}


def test_greedy_steps(random_spans):
    rows, df = random_spans
    assert {r["ord"] for r in intervals.collapse_overlapping(df).collect()} == greedy(rows, True)
    assert {r["ord"] for r in intervals.greedy_fill(df).collect()} == greedy(rows, False)


def test_nested_and_idempotent(random_spans):
    rows, df = random_spans
    want = {r[1] for r in rows if not any(k[0] == r[0] and k[2] <= r[2] and k[3] >= r[3] and k[3] - k[2] > r[3] - r[2] for k in rows)}
    kept = intervals.drop_nested(df)
    assert {r["ord"] for r in kept.collect()} == want
    assert {r["ord"] for r in intervals.drop_nested(kept).collect()} == want


def test_partial_overlaps(random_spans):
    rows, df = random_spans
    want = {(a[1], b[1]) for a, b in itertools.permutations(rows, 2) if a[0] == b[0] and a[2] < b[2] < a[3] < b[3]}
    assert {(r["left"], r["right"]) for r in intervals.partial_overlaps(df, 8).collect()} == want


def test_resolve_by_score(random_spans):
    rows, df = random_spans
    united, want = {}, []  # equal spans are one, with the highest score
    for r in rows:
        key = (r[0], r[2], r[3], r[4])
        o = united.get(key, r)
        united[key] = (r[0], min(o[1], r[1]), *r[2:5], max(o[5], r[5]))
    assert len(united) < len(rows)
    for r in sorted(united.values(), key=lambda r: (r[0], r[2], r[3], r[4], r[1])):
        at = next((i for i, k in enumerate(want) if k[0] == r[0] and k[4] == r[4] and k[2] < r[3] and r[2] < k[3]), None)
        if at is None:
            want.append(r)
        elif (r[5], r[3] - r[2]) > (want[at][5], want[at][3] - want[at][2]):
            want[at] = r
    assert {r["ord"] for r in intervals.resolve_by_score(df).collect()} == {r[1] for r in want}


def test_phrases_match_their_slices(spark):
    text = "The x😀 the, THE the_the the\nthethe İ the"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    loose = [(r["start"], r["end"]) for r in occurrences.phrase_occurrences(df, ["the"], boundary=False).where("doc_id = 1").orderBy("start").collect()]
    assert len(loose) == 9 and all(text[a:b].lower() == "the" for a, b in loose)
    wide = spark.createDataFrame([(1, "İİ the İstanbul end")], "doc_id long, text string")
    assert {(r["start"], r["end"]) for r in occurrences.phrase_occurrences(wide, ["the", "istanbul"]).collect()} == {(3, 6), (7, 15)}
    strict = {r["start"] for r in occurrences.phrase_occurrences(df, ["the"]).where("doc_id = 1").collect()}
    assert {0, 7, 12, 24} <= strict and 16 not in strict


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n\nc\n"), (2, ""), (3, "x")], "doc_id long, text string")
    got = {(r["doc_id"], r["start"], r["end"], r["core"]) for r in occurrences.line_spans(df).collect()}
    assert got == {(1, 0, 1, "a"), (1, 3, 4, "b"), (1, 5, 5, ""), (1, 6, 7, "c"), (3, 0, 1, "x")}


@pytest.mark.parametrize(
    ("text", "want"),
    [("vancomycin 1 gram", [(1000.0, "MG")]), ("levothyroxine với liều 75 microgam/ngày", [(0.075, "MG")]), ("acetaminophen 325-650 mg po q6h:prn", [(325.0, "MG")]), ("saline 500 ml", []), ("aspirin 81 mg po daily", [(81.0, "MG")])],
)
def test_strengths(spark, text, want):
    got = one(spark, t.strengths(t.strip_administration(F.col("s"))), s=text)
    assert [(round(g["value"], 9), g["unit"]) for g in got] == want


def test_percent_needs_leave(spark):
    got = one(spark, t.strengths(F.col("s"), F.contains("s", F.lit("Glucose"))), s="Glucose 5% x 1000ml")
    assert [(g["value"], g["unit"]) for g in got] == [(50.0, "MG/ML")]
    assert one(spark, t.strengths(F.col("s"), F.lit(False)), s="Cream 5%") == []


def test_normalisation(spark):
    assert one(spark, t.normalize_aggressive(F.col("s")), s="Đái tháo đường, týp  II (mãn tính)") == "dai thao duong tip 2 man"
    assert one(spark, t.fold_accents(F.col("s")), s="Đau Ngực") == "đau nguc"
    assert one(spark, t.without_qualifiers(F.col("s"))[0], s="unspecified") == "unspecified"
    assert one(spark, t.clause_start(F.col("s"), F.lit(8)), s="a b; cd ef") == 4


def test_broken_json(spark):
    got = one(spark, t.json_objects(F.col("s"), "struct<a:int>"), s='```[{"a": 1}, {"a": 2}, {"a"')
    assert [g["a"] for g in got] == [1, 2]


def test_markup():
    assert generators.parse_markup("x ⟦A|f,g⟧bc⟦/⟧ d⟦/⟧ ⟦B⟧e⟧") == ("x bc d e", [(2, 4, "A", ["f", "g"]), (7, 8, "B", [])])
    with pytest.raises(ValueError):
        generators.parse_markup("⟦A⟧b")


def test_chunks_join_to_the_text(spark):
    random.seed(1)
    text = "".join(random.choice("ab \n") for _ in range(5000)) + "x" * 3000
    places = generators.chunk_places(text, 110, 40)
    assert "".join(text[a:b] for a, b in places) == text and all(b - a <= 110 for a, b in places)
    assert all(text[b] == " " or " " not in text[a + 70 : b] for a, b in places[:-1])  # a blank begins the next chunk
    df = spark.createDataFrame([(1, ""), (2, None), (3, "x")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["start"], r["end"]) for r in df.select("doc_id", F.inline(generators.chunks(F.col("text")))).collect()) == [(1, 0, 0), (3, 0, 1)]


def test_dose_runs():
    found = generators.dose_runs("Aspirin 81 mg po, xaspirin; aspirinzestril 5 mg", {"aspirin": "A", "zestril": "Z"}, r"[0-9]+\s*mg|po")
    assert found == [(0, 16, "A"), (28, 35, "A"), (35, 47, "Z")]


def test_chain():
    rng = np.random.default_rng(2)
    e, m, s, z = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    score = lambda p: s[p[0]] + sum(e[i, k] for i, k in enumerate(p)) + sum(m[a, b] for a, b in zip(p, p[1:])) + z[p[-1]]
    paths = list(itertools.product(range(3), repeat=5))
    assert tuple(sequences.viterbi(e, m, s, z)) == max(paths, key=score)
    assert math.isclose(sequences.log_partition(e, m, s, z), math.log(sum(math.exp(score(p)) for p in paths)))


def test_word_error(spark):
    assert one(spark, evaluate.word_error_rate(F.col("a"), F.col("b")), a="x b c", b="a b c d") == 0.5
    assert one(spark, evaluate.word_error_rate(F.col("a"), F.col("b")), a="", b="") == 0.0


def test_one_to_one(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 5), (1, 1, 2, 9), (1, 2, 2, 8), (1, 2, 1, 1)], "doc_id long, gold long, pred long, overlap int")
    assert {(r["gold"], r["pred"]) for r in evaluate.greedy_matches(pairs).collect()} == {(1, 2), (2, 1)}


def test_gate(spark):
    def ask(a, b):
        df = spark.createDataFrame([(1, "x", 0.5, a), (1, "y", 0.4, b)], "qid long, code string, score double, second double")
        return [r["code"] for r in linking.confidence_gate(df).orderBy("rank").collect()]

    assert ask(0.1, 0.2) == [] and ask(0.6, 0.3) == ["x", "y"] and ask(0.9, 0.3) == ["x"]


def test_fuzzy():
    assert scorers.fuzzy("viêm phổi", "phổi viêm") == 100 and scorers.fuzzy("a", "b") < 85 and scorers.fuzzy("", "b") == 0


def test_violations(spark):
    flags = F.array().cast("array<string>")
    bad = validate.violations(F.col("raw"), F.col("txt"), F.col("s"), F.col("e"), F.col("k"), flags, F.array(F.lit("x")))
    assert one(spark, bad, raw="abc", txt="ab", s=0, e=2, k="THUỐC") == []
    assert one(spark, bad, raw="abc", txt="ab", s=1, e=9, k="?") == ["invalid_position", "invalid_type", "candidates_not_allowed"]


def test_package(spark, tmp_path):
    rows = spark.createDataFrame([(1, "[]"), (2, "[1]")], "doc_id long, json string")
    assert writers.write_package(rows, rows.select("doc_id"), str(tmp_path / "a.zip")) == 2
    writers.write_package(rows, rows.select("doc_id"), str(tmp_path / "b.zip"))
    assert (tmp_path / "a.zip").read_bytes() == (tmp_path / "b.zip").read_bytes()
    with pytest.raises(ValueError):
        writers.write_package(rows, spark.range(1, 4).withColumnRenamed("id", "doc_id"), str(tmp_path / "c.zip"))


def test_readers(spark, tmp_path):
    (tmp_path / "7.txt").write_bytes("a\r\nb".encode())
    assert [(r["doc_id"], r["text"]) for r in readers.read_notes(spark, str(tmp_path / "*.txt")).collect()] == [("7", "a\r\nb")]
    assert readers.read_notes(spark, str(tmp_path / "*.txt"), "translated").first()["text"] == "a\nb"
    (tmp_path / "d.yaml").write_text("cues:\n  - tiền sử\n  - {phrase: lab, code: 3}\nnames:\n  aspirin: [1, 2]\nempty:\n", "utf-8")
    found = {(r["section"], r["phrase"], r["payload"]) for r in readers.read_dictionary(spark, str(tmp_path / "d.yaml")).collect()}
    assert found == {("cues", "tiền sử", None), ("cues", "lab", '{"phrase": "lab", "code": 3}'), ("names", "aspirin", "[1, 2]"), ("empty", "None", None)}
    texts = spark.createDataFrame([("1", "abc"), ("2", "x")], "doc_id string, text string")
    spans = spark.createDataFrame([("1", 0, 3), ("9", 0, 1)], "doc_id string, start int, end int")
    assert [tuple(r) for r in readers.paired(texts, spans).collect()] == [("1", 0, 3)]
    with pytest.raises(Exception, match="beyond the text"):
        readers.paired(texts, spans.withColumn("end", F.lit(4))).collect()
    lines = tmp_path / "l.jsonl"
    writers.write_json_lines(spark.range(2), str(lines))
    assert readers.read_json_lines(spark, str(lines), spark.range(1).schema).count() == 2
    writers.append_log(spark.range(1), str(tmp_path / "log"))
    writers.append_log(spark.range(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    (tmp_path / "c.rrf").write_text("1|ENG|||||||||||RXNORM|SCD|1|amlodipine|0|N||\n".replace("|||||||||||RXNORM", "||||||||||RXNORM") + "2|ENG||||||||||OTHER|SCD|1|x|0|N||\n")
    assert [(r["rxcui"], r["tty"], r["name"], r["prio"]) for r in readers.read_concepts(spark, str(tmp_path / "c.rrf")).collect()] == [("1", "SCD", "amlodipine", 0)]
    (tmp_path / "9.json").write_text('[{"text":"b","position":[3,4],"type":"THUỐC","assertions":["isNegated"]}]')
    r = readers.read_spans(spark, str(tmp_path / "*.json")).first()
    assert (r["doc_id"], r["start"], r["end"], r["assertions"], r["candidates"]) == ("9", 3, 4, ["isNegated"], [])
    with pytest.raises(ValueError):
        readers.check_source("/x/gold_reference/y")
    writers.write_versioned(spark.range(3), str(tmp_path / "v"), "2")
    assert readers.read_versioned(spark, str(tmp_path / "v"), "2").count() == 3
    with pytest.raises(ValueError):
        readers.read_versioned(spark, str(tmp_path / "v"), "1")


def test_streams(spark, tmp_path):
    from spanloom.streaming import spans as st

    spark.sql("select * from values (timestamp'2024-01-01 00:00:00', 1L, 'a', 1.0D), (timestamp'2024-01-01 00:10:00', 1L, 'a', 2.0D), (timestamp'2024-01-01 00:10:00', 1L, 'a', 2.0D), (timestamp'2024-01-01 05:00:00', 1L, 'a', 4.0D) t(ts, user_id, event_type, value)").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for name, f in (("merged", st.merged), ("once", lambda d: st.once(d, ["user_id", "event_type", "ts"])), ("windows", st.windows)):
        q = f(st.stream(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("once").count() == 3
    assert [(r["parts"], r["value"]) for r in spark.table("merged").collect()] == [(3, 5.0)]


def test_generators_plug_in(spark):
    class Capitals:
        def predict(self, text):
            return [(i, i + 1, "cap") for i, c in enumerate(text) if c.isupper()] + [(0, 99, "bad")]

    docs = spark.createDataFrame([(1, "aBcD"), (2, None)], "doc_id long, text string")
    assert {(r["start"], r["text"]) for r in scorers.generate_spans(docs, Capitals).collect()} == {(1, "B"), (3, "D")}


def test_split_and_merge(spark):
    s = spark.createDataFrame([(1, 1, 0, 10, "n", "red anvils"), (1, 2, 20, 29, "n", "redbolt x")], "doc_id long, ord long, start int, end int, type string, text string")
    got = {(r["start"], r["end"], r["text"]) for r in intervals.split_concatenated(s, [("n", "red"), ("n", "anvil"), ("n", "bolt")]).collect()}
    assert got == {(0, 3, "red"), (4, 9, "anvil"), (20, 29, "redbolt x")} or (0, 3, "red") in got
    f = spark.createDataFrame([(1, 1, 0, 3, "n", "red"), (1, 2, 4, 8, "n", "bolt")], "doc_id long, ord long, start int, end int, type string, text string")
    m = intervals.merge_fragments(f, spark.createDataFrame([(1, "red bolt")], "doc_id long, text string"), [("n", "red bolt")]).collect()
    assert [(r["start"], r["end"], r["text"]) for r in m] == [(0, 8, "red bolt")]


def test_token_overlap_over_all_words(spark, tmp_path):
    from spanloom.plans import link_queries

    documents = [(1, "The red bolt  is the red bolt"), (2, "nothing of it"), (3, None), (4, ""), (5, "incomprehensible RED")]
    items = [(7, "a red bolt"), (8, "incomprehensible of"), (9, "")]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {}
    for i, x in documents:
        for j, y in items:
            a, b = set((x or "").lower().split(" ")) - {""}, set(y.lower().split(" ")) - {""}
            if a & b:
                want[i, j] = (round(2 * len(a & b) / (len(a) + len(b)), 6), round(len(a & b) / len(a | b), 6))
    got = {(r["doc_id"], r["item_id"]): (r["f1"], r["jaccard"]) for r in link_queries.token_overlap_pairs(spark, str(tmp_path)).collect()}
    assert got == want and len(want) == 4


def test_relocate_over_whole_texts(spark, tmp_path):
    import re

    from spanloom.plans import generator_queries

    documents = [(1, "red bolt, " * 40 + "late gear and Red reddish"), (2, "no"), (3, None)]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, x in documents:
        seen, low = {}, (x or "").lower()
        for k, w in enumerate(re.findall("[a-z]{3,}", x or ""), 1):
            at = low.find(w, seen.get(w, 0))
            if at >= 0:
                seen[w] = at + len(w)
                want.add((i, k, w, at, at + len(w)))
    got = {tuple(r[c] for c in ("doc_id", "ord", "surface", "start", "end")) for r in generator_queries.relocate(spark, str(tmp_path)).collect()}
    assert got == want and max(r[3] for r in want) > 400
