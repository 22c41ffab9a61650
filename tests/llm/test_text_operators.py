"""Token counts, line windows, near copies, classifiers and packing against plain versions; edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bpe, components, line_dedup, order_minhash, packing, quality, textnum, token_counts, toxicity, url_filter
from spanloom.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=False):
    rows = [(i, x, "en", "s", None if x is None else len(x)) for i, x in texts]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("rid", F.lit(1)).withColumn("N_Removed", F.lit("x")).withColumn("h", F.lit(2)) if extra else df


def words(text):
    return (text or "").lower().split()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_words_and_long_rows(monkeypatch):
    monkeypatch.setattr(textnum.segments, "__defaults__", (40, textnum.SPACE, None))
    column = pa.array(["a bb  c", None, "", "word " * 60, "x" * 200, " lead"])
    got = [(lo, hi, w, c) for lo, hi, w, c in textnum.whole_rows(textnum.words(column))]
    counts = np.concatenate([c for *_, c in got])
    assert counts.tolist() == [3, 0, 0, 60, 1, 1]
    assert len(set(next(w for lo, hi, w, c in got if lo == 3).tolist())) == 1


def test_banded_edits():
    random.seed(8)
    for _ in range(500):
        a = [random.randint(0, 9) for _ in range(random.randint(0, 30))]
        b = [x if random.random() > 0.2 else random.randint(0, 9) for x in a if random.random() > 0.1]
        most = random.randint(0, 20)
        assert order_minhash.banded_edits(np.array(a, np.uint32), np.array(b, np.uint32), most) == min(edits(a, b), most + 1)


def test_histogram(spark):
    texts = [(i, "tok " * (i % 5)) for i in range(20)] + [(99, None)]
    df = docs(spark, texts, True)
    sums = token_counts.suffix_sums(token_counts.length_histogram(df, eos=1), block=2)
    lengths = [n + 1 for n in bpe.encoder(bpe.default_tokenizer()).lengths(pa.array([x for _, x in texts])).tolist()]
    got = sorted((r["n_tokens"], r["n_docs"], r["docs_ge"], r["tokens_ge"], r["truncated_total"]) for r in sums.collect())
    assert got == token_counts.brute_force(lengths)
    for r in token_counts.truncated_totals(sums, [1, 3, 100]).collect():
        assert r["truncated_total"] == sum(min(n, r["context_limit"]) for n in lengths)
    assert {r["share"]: r["n_tokens"] for r in token_counts.quantiles(sums, [0.5, 1.0]).collect()} == {0.5: sorted(lengths)[len(lengths) // 2], 1.0: max(lengths)}
    assert token_counts.suffix_sums(token_counts.length_histogram(df.where("false"))).count() == 0


def plain_windows(rows, n=3):
    """(doc_id, text) -> text left, for distinct ids."""
    first, out = {}, {}
    lines = {i: x.split("\n") for i, x in rows if x is not None}
    for i in sorted(lines):
        gone = set()
        for p in range(len(lines[i]) - n + 1):
            key = tuple(lines[i][p : p + n])
            if key in first:
                gone |= set(range(p, p + n))
            first.setdefault(key, (i, p))
        out[i] = "\n".join(x for k, x in enumerate(lines[i]) if k not in gone)
    return out


def test_line_windows(spark):
    random.seed(3)
    rows = [(i, "\n".join(random.choice("abc") for _ in range(random.randint(0, 9)))) for i in range(60)] + [(70, None), (71, "q\n" * 5)]
    got = line_dedup.without_repeats(docs(spark, rows, True))
    assert "N_Removed" in got.columns and "n_removed_" in [c.lower() for c in got.columns]
    assert {r["doc_id"]: r["text"] for r in got.collect() if r["text"] is not None} == plain_windows(rows)
    # rows that repeat are one document; a null id sorts last
    twice = docs(spark, [(5, "a\nb\nc"), (5, "a\nb\nc"), (None, "a\nb\nc")])
    assert sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.without_repeats(twice).collect()) == [("5", "a\nb\nc"), ("5", "a\nb\nc"), ("None", "")]
    assert line_dedup.without_repeats(twice.where("false")).count() == 0


@pytest.fixture(scope="module")
def copies():
    random.seed(12)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, i = [], 0
    for _ in range(25):
        base = [random.choice(vocabulary) for _ in range(random.randint(20, 120))]
        for _ in range(random.randint(1, 5)):
            w = list(base)
            for _ in range(len(w) // 30):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            rows.append((i, " ".join(w)))
            i += 1
    passage = " ".join(random.choice(vocabulary) for _ in range(60))
    rows += [(1000 + k, passage + " " + " ".join(random.choice(vocabulary) for _ in range(90))) for k in range(15)]
    return rows + [(2000, ""), (2001, None), (2002, "one two"), (2003, "ONE  two"), (2004, "  ")]


def test_near_copies(spark, copies):
    got = order_minhash.near_duplicates(docs(spark, copies, True)).collect()
    component = {r["doc_id"]: r["component_id"] for r in got}
    text = {i: words(x) for i, x in copies}
    parent = {i: i for i in text}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in text:
        for b in text:
            if a < b and (text[a] == text[b] or (text[a] and edits(text[a], text[b]) <= int(0.2 * max(len(text[a]), len(text[b])) + 1e-9))):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert component == {i: root(i) for i in text}
    assert {r["doc_id"] for r in got if r["kept"]} == set(component.values())
    left = order_minhash.one_of_each(docs(spark, copies, True))
    assert {r["doc_id"] for r in left.collect()} == set(component.values()) and "rid" in left.columns
    assert order_minhash.near_duplicates(docs(spark, copies).where("false")).count() == 0


def test_short_near_copies(spark):
    random.seed(4)
    texts, pairs = [], []
    for n in (4, 5, 6, 7, 9, 10, 12, 14, 15, 16, 20, 24, 33, 40, 51, 64):
        for at in range(3):
            a = [f"w{n}x{at}y{k}" for k in range(n)]
            b, most = list(a), n // 5 if n > 4 else 0
            for e in range(most):  # spread evenly, the worst for shared stretches
                b[min((2 * e + 1 + at % 2) * n // (2 * most), n - 1)] = f"e{n}x{at}y{e}"
            texts += [(len(texts), " ".join(a)), (len(texts) + 1, " ".join(b))]
            if at == 2:  # one word fewer, but as many edits
                b = a[: n // 2] + a[n // 2 + 1 :]
                texts[-1] = (texts[-1][0], " ".join(b))
            pairs.append((texts[-2], texts[-1]))
    component = {r["doc_id"]: r["component_id"] for r in order_minhash.near_duplicates(docs(spark, texts)).collect()}
    for (i, a), (j, b) in pairs:
        a, b = words(a), words(b)
        linked = edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)
        assert (component[i] == component[j]) == linked, (a, b)


def test_stretches_of_any_edits():
    random.seed(5)
    for _ in range(3000):
        a = [random.randint(0, 5) for _ in range(random.randint(1, 64))]
        b, most = list(a), random.randint(0, len(a) // 4)
        for _ in range(most):
            k = random.randrange(len(b) + 1)
            b[k : k + random.randint(0, 1)] = random.choices(range(6, 60), k=random.randint(0, 1))
        t = random.choice([0.8, 0.8, 0.7, 0.9])
        if a == b or not b or max(len(a), len(b)) > 64 or edits(a, b) > int(max(len(a), len(b)) * (1 - t) + 1e-9):
            continue
        row, keys = order_minhash.stretch_keys(np.array(a + b, np.uint64), np.array([len(a), len(b)]), 64, t)
        assert set(keys[row == 0].tolist()) & set(keys[row == 1].tolist()), (a, b, t)


def test_repeated_rows_keep_one(spark):
    df = docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "x")])
    assert sorted(str(r["doc_id"]) for r in order_minhash.one_of_each(df).collect()) == ["1", "None"]


@pytest.mark.parametrize("few", [0, 200_000])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr(components, "FEW", few)
    links = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(5, 5), (3, 2)]
    got = components.connected_components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t"))
    assert {r["node"]: r["component"] for r in got.collect()} == {i: i // 10 * 10 for i in range(40)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_packing(spark):
    random.seed(9)
    rows = [(i, " ".join(random.choice(["alpha", "beta", "x"]) for _ in range(random.choice([0, 3, 40, 300])))) for i in range(80)] + [(500, None), (500, None)]
    got = packing.pack(docs(spark, rows, True), size=64).toPandas()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.default_tokenizer())
    for i, x in rows:
        ids = np.array([*own.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        mine = got[got.doc_id == i].sort_values("piece")
        if i == 500:
            assert len(mine) == 2 and (mine.length == 1).all()
            continue
        assert mine.length.sum() == len(ids) and mine.piece.tolist() == list(range(len(mine))) and (mine.length.iloc[1:] == 64).all()
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(mine.start, mine.length, mine.ids_crc32, strict=True))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= 64
    assert got.sequence_id.nunique() <= packing.best_fit(got.length.to_numpy(), 64)[0].max() + 1 + 2
    assert packing.pack(docs(spark, rows).where("false")).count() == 0


def test_best_fit_never_overfills():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 64, 5000)
    bins, offsets = packing.best_fit(n, 64)
    fill = np.bincount(bins, n)
    assert fill.max() <= 64 and len(fill) <= -(-n.sum() // 64) * 1.02 + 1
    assert all(sorted(offsets[bins == b].tolist()) == [0, *np.cumsum(n[bins == b][np.argsort(offsets[bins == b])])[:-1].tolist()] for b in range(50))


def test_toxicity_holds_out_and_ranks(spark, sf):
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    r = toxicity.judge(d.withColumn("score", F.lit("x")), lab).toPandas()
    assert len(r) == d.count() and r.score.between(0, 1).all() and ((r.score >= 0.5) == (r.predicted == 1)).all()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(r.doc_id, r.held_out, strict=True))
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.judge(d, flipped).toPandas().set_index("doc_id").score
    assert np.allclose(again, r.set_index("doc_id").score.loc[again.index])  # held-out labels don't matter
    empty = toxicity.judge(docs(spark, [(1, None), (2, "")]), lab.where("false")).collect()
    assert [round(x["score"], 6) for x in empty] == [0.5, 0.5]


def test_swapping_spares_neutral_mentions():
    random.seed(2)
    key = lambda ws: np.unique(toxicity.word_keys(ws))
    plain = [f"n{i}" for i in range(60)]
    rows, y = [], []
    for i in range(400):
        bad, named = i % 2, random.random() < (0.95 if i % 2 else 0.05)
        rows.append(key([*random.sample(plain, 8), *(["vile"] if bad and random.random() < 0.5 else []), *(["muslims"] if named else [])]))
        y.append(bad)
    neutral = [key([*random.sample(plain, 8), "muslims"]) for _ in range(50)]

    def flagged(swap):
        m = toxicity.fit_words(rows, np.array(y), swap=swap)
        return np.mean([toxicity.sigmoid(m.bias + m.weights[np.isin(m.keys, r)].sum()) >= 0.5 for r in neutral])

    assert flagged(0.0) > 0.5 > flagged(20.0)


def test_quality(spark, sf):
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out, names = quality.with_quality(d.withColumn("Score", F.lit("mine")), lab)
    r = out.toPandas().merge(lab.toPandas(), on="doc_id")
    assert names["score"] != "score" and (r.Score == "mine").all()
    assert (r[names["accepted"]] == r.quality).mean() > 0.9
    odd = docs(spark, [(1, None), (None, ""), (3, "x" * 50_000)]).withColumn("source", F.lit(None).cast("string"))
    assert quality.with_quality(odd, lab.where("false"))[0].count() == 3
    assert quality.with_quality(odd.where("false"), lab)[0].count() == 0


def test_small_sites_shrink(spark):
    text = "Plain words stand here. "
    rows = [(i, text * 3 if i % 10 else "### " * 20, "en", "big", 1) for i in range(200)] + [(900, text, "en", "tiny", 1)]
    d = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(200)], "doc_id long, quality int")
    r = quality.with_quality(d, lab)[0].toPandas().set_index("doc_id")
    assert abs(r.site_rate[900] - r.site_rate[11]) < 0.1 and r.accepted[900] == 1 and r.accepted[20] == 0


def test_url_rules(spark):
    urls = ["http://www.example.com/en/x", "https://M.Example.com/en/", "http://a.net/fr/y?q", "http://a.net/de/", "x.com/en/", None, "http://com", "http://com/", "ftp://h.org#f", "http://example.com/EN/"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, labels).collect()}
    assert got == {
        0: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 1: ("m.example.com", "/en/", "example.com/en/", "block"), 2: ("a.net", "/fr/y", "net/fr/", "block"), 3: ("a.net", "/de/", None, "allow"),
        4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("com", "", None, "allow"), 7: ("com", "/", "com/", "allow"), 8: ("h.org", "", None, "allow"), 9: ("example.com", "/EN/", "com/", "allow"),
    }


def test_bad_hosts_are_blocked(spark):
    rows = [(i, f"http://bad.org/{i}") for i in range(60)] + [(100 + i, f"http://good{i % 20}.org/") for i in range(200)] + [(900, "http://once.org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 100 and i != 900), 0) for i, _ in rows] + [(None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, labels).collect()}
    assert got[3] == "block" and got[150] == "allow" and got[900] == "allow"  # one bad page blocks no host


def test_bad_rates_by_brute_force(spark):
    random.seed(14)
    hosts = ["a.x.org", "b.x.org", "c.y.org", "d.z.net", "z.net", "", "lonely"]
    rows = [(h, n := random.randint(0, 9), random.randint(0, n)) for h in hosts for _ in range(3)]
    of = {h: [sum(r[1] for r in rows if r[0] == h), sum(r[2] for r in rows if r[0] == h)] for h in hosts}
    domain = {h: ".".join(h.split(".")[-2:]) for h in hosts}
    suffix = {h: h.split(".")[-1] for h in hosts}

    def merged(name):
        out = {}
        for h, (n, y) in of.items():
            a = out.setdefault(name[h], [0, 0])
            a[0], a[1] = a[0] + n, a[1] + y
        return out

    def pull(groups):
        seen = [(n, y) for n, y in groups if n]
        total = sum(n for n, _ in seen)
        p, nn = sum(y for _, y in seen) / total, sum(n * n for n, _ in seen)
        spare = total - nn / total
        spread = (sum(y * y / n for n, y in seen) - total * p * p - (len(seen) - 1) * p * (1 - p)) / spare if spare > 0 else 0
        return min(max(p * (1 - p) / spread - 1, 1.0), 1000.0) if spread > 1e-12 else 1000.0

    domains, suffixes = merged(domain), merged(suffix)
    base = (sum(y for _, y in of.values()) + 1) / (sum(n for n, _ in of.values()) + 2)
    ps, pd_, ph = pull(suffixes.values()), pull(domains.values()), pull(of.values())
    got = {r["host"]: (r["rate"], r["low"]) for r in url_filter.reputation(spark.createDataFrame(rows, "host string, n int, y int")).collect()}
    for h in hosts:
        s = (suffixes[suffix[h]][1] + ps * base) / (suffixes[suffix[h]][0] + ps)
        d = (domains[domain[h]][1] + pd_ * s) / (domains[domain[h]][0] + pd_)
        rate = (of[h][1] + ph * d) / (of[h][0] + ph)
        assert abs(got[h][0] - rate) < 1e-12 and abs(got[h][1] - (rate - 1.645 * (rate * (1 - rate) / (of[h][0] + ph + 1)) ** 0.5)) < 1e-12


def test_quality_by_brute_force(spark):
    random.seed(15)
    rows = []
    for i in range(120):
        good = random.random() < 0.6
        rows.append((i, ("Plain words stand here. " if good else "### !!! ||| 000 ") * random.randint(1, 9), random.choice(["p", "q", None]), random.choice(["h1", "h2", "h3", None]), 1))
    d = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame([(i, int(r[1][0] == "P")) for i, r in enumerate(rows)], "doc_id long, quality int")
    model = quality.fit(d, lab)
    evidence = model.evidence(quality.features(pa.array([r[1] for r in rows])))
    base = np.log(model.prior / (1 - model.prior))
    share = 1 / (1 + np.exp(-(evidence + base)))
    sums = {}
    for r, y in zip(rows, share, strict=True):
        for key in ((r[3],), (r[3], r[2])):
            a = sums.setdefault(key, [0, 0.0])
            a[0], a[1] = a[0] + 1, a[1] + y

    def pull(groups):
        total, y = sum(n for n, _ in groups), sum(y for _, y in groups)
        p, nn = y / total, sum(n * n for n, _ in groups)
        spread = (sum(y * y / n for n, y in groups) - total * p * p - (len(groups) - 1) * p * (1 - p)) / (total - nn / total)
        return min(max(p * (1 - p) / spread - 1, 1.0), 1000.0) if spread > 1e-12 else 1000.0

    hosts, paths = [v for k, v in sums.items() if len(k) == 1], [v for k, v in sums.items() if len(k) == 2]
    rate, ph, pp = (share.sum() + 1) / (len(rows) + 2), pull(hosts), pull(paths)
    got = {r["doc_id"]: r for r in quality.with_quality(d, lab)[0].collect()}
    for r, e, y in zip(rows, evidence, share, strict=True):
        (hn, hy), (pn, py) = sums[(r[3],)], sums[(r[3], r[2])]
        of_h = (max(hy - y, 0) + ph * rate) / (hn - 1 + ph)
        of_p = min(max((max(py - y, 0) + pp * of_h) / (pn - 1 + pp), 1e-6), 1 - 1e-6)
        score = 1 / (1 + np.exp(-(e + np.log(of_p / (1 - of_p)))))
        assert abs(got[r[0]]["site_rate"] - of_p) < 1e-9 and abs(got[r[0]]["score"] - score) < 1e-9


def test_toxicity_by_brute_force(spark, sf):
    """Scores against sets of words, and the features against plain counts."""
    import re

    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(d, lab)
    odd = [(900001, None), (900002, ""), (900003, "word " * 60_000), (1, "repeated"), (1, "repeated")]
    both = d.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    texts, scores = [r["text"] for r in both.collect()], [r["x"] for r in both.select(toxicity.score(F.col("text"), model).alias("x")).collect()]
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    words_of = lambda x: {w.lower() for w in re.findall(r"[A-Za-z0-9\u0080-\uffff]+", x or "")}
    for x, got in zip(texts, scores, strict=True):
        own = words_of(x)
        plain = model.bias + sum(weight.get(int(k), 0.0) for k in (toxicity.word_keys(sorted(own)) if own else []))
        assert abs(got - toxicity.sigmoid(np.array(plain))) < 1e-9
    marks = {r["doc_id"]: r["toxic"] for r in lab.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    rows = [(words_of(r["text"]), marks[r["doc_id"]]) for r in d.collect() if r["doc_id"] in marks]
    toxic, clean = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    counts = {}
    for ws, y in rows:
        for w in ws:
            c = counts.setdefault(w, [0, 0])
            c[0], c[1] = c[0] + 1, c[1] + y
    far = lambda n, t: abs(t / toxic - (n - t) / clean) / max(n / len(rows) * (1 - n / len(rows)) * (1 / toxic + 1 / clean), 1e-12) ** 0.5
    want = {w for w, (n, t) in counts.items() if n >= 4 and far(n, t) >= 4.0} - set(toxicity.IDENTITIES)
    assert set(toxicity.word_keys(sorted(want | set(toxicity.IDENTITIES))).tolist()) == set(model.keys.tolist()) and want


def test_default_swap_spares_neutral_mentions():
    random.seed(2)
    key = lambda ws: np.unique(toxicity.word_keys(ws))
    plain = [f"n{i}" for i in range(60)]
    rows, y = [], []
    for i in range(400):
        bad, named = i % 2, random.random() < (0.95 if i % 2 else 0.05)
        rows.append(key([*random.sample(plain, 8), *(["vile"] if bad and random.random() < 0.5 else []), *(["muslims"] if named else [])]))
        y.append(bad)
    m = toxicity.fit_words(rows, np.array(y))
    flagged = [toxicity.sigmoid(m.bias + m.weights[np.isin(m.keys, key([*random.sample(plain, 8), "muslims"]))].sum()) >= 0.5 for _ in range(50)]
    assert not any(flagged)


def test_ids_that_are_texts(spark):
    rows = [("b", "a b c d e f\nx\ny"), ("a", "a b c d e f\nx\ny"), ("c", "other\nlines\nhere"), (None, "other\nlines\nhere"), (None, None), ("d", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r["doc_id"], r["text"]) for r in line_dedup.without_repeats(df).collect()}
    assert got == {("a", "a b c d e f\nx\ny"), ("b", ""), ("c", "other\nlines\nhere"), (None, ""), (None, None), ("d", None)}
    assert sorted(str(r["doc_id"]) for r in order_minhash.one_of_each(df).collect()) == ["a", "c", "d"]
    assert {r["doc_id"] for r in packing.pack(df).collect()} == {"a", "b", "c", "d", None}


def test_very_long_texts(spark):
    long_ = "alpha beta gamma " * 60_000  # about a million characters
    other = long_ + "delta"
    df = docs(spark, [(1, long_), (2, other), (3, "alpha\n" * 50_000), (4, "x")], True)
    assert {r["doc_id"]: r["component_id"] for r in order_minhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    n = bpe.encoder(bpe.default_tokenizer()).lengths(pa.array([long_])).tolist()[0]
    assert df.where("doc_id = 1").select(token_counts.token_count(F.col("text")).alias("n")).first()["n"] == n
    left = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(df).collect()}
    assert left[3] == "alpha\n"  # all later windows of the run go, and what they cover
    assert len(left[1]) == len(long_)


def test_empty_tables_and_repeated_pages(spark):
    pages = spark.createDataFrame([(1, "http://h.org/a"), (1, "http://h.org/a"), (None, "http://h.org/b")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r["page_id"], r["verdict"]) for r in url_filter.judge(pages, labels).orderBy("page_id").collect()] == [(None, "allow"), (1, "allow"), (1, "allow")]
    assert url_filter.judge(pages.where("false"), labels).count() == 0
    assert toxicity.judge(docs(spark, [(1, "x")]).where("false"), labels).count() == 0
    twice = quality.with_quality(docs(spark, [(1, "x"), (1, "x"), (None, None)]), labels)[0].collect()
    assert len(twice) == 3


def test_large_groups_in_tiles(spark):
    """A group of near copies that hardly any two members of share a first pick with, in parts of few members."""
    random.seed(16)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in random.sample(range(100), 10):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"z{i}q{k}" for k in range(60)) + " " + " ".join(base[:40])) for i in range(20)]
    df = docs(spark, rows)
    want = {i: 0 if i < 100 else i for i, _ in rows}
    for options in ({}, {"tile": 7}, {"first": 1, "tile": 16}):
        assert {r["doc_id"]: r["component_id"] for r in order_minhash.near_duplicates(df, **options).collect()} == want
