"""Splits, balancing and the rows that training reads; chance comes from hashes, so runs agree."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def chance(key: Column, seed: int) -> Column:
    """A reproducible order: the MD5 of key and seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def _ranked(df: DataFrame, by: str, order: str, tie: str) -> DataFrame:
    """Adds ``_r``, the place of each row of a stratum in the order of the hash ``order``, and ``_n``, its rows.

    A stratum is cut into 256 parts by the first two signs of the hash, so it is ranked by many tasks; the
    rows of earlier parts are counted before.
    """
    part = F.substring(order, 1, 2)
    rows = df.withColumn("_part", part)
    counts = rows.groupBy(by, "_part").agg(F.count("*").alias("_m"))
    w = W.partitionBy(by)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_m").over(w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_m").over(w)).drop("_m")
    inside = F.row_number().over(W.partitionBy(by, "_part").orderBy(order, tie))
    ranked = rows.withColumn("_inside", inside).join(counts.select(F.col(by).alias("_by"), F.col("_part").alias("_of"), "_before", "_n"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_of")))
    return ranked.withColumn("_r", F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_by", "_of", "_before")


def stratified_split(df: DataFrame, key: str, stratum: str, ratio: float, seed: int = 42) -> DataFrame:
    """Adds ``subset``: per stratum max(1, round(n * ratio)) rows for validation, none of a single row."""
    rows = _ranked(df.withColumn("_c", chance(F.col(key), seed)), stratum, "_c", key)
    want = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.bround(F.col("_n") * ratio).cast("int"))).otherwise(0)
    return rows.withColumn("subset", F.when(F.col("_r") <= want, "validation").otherwise("train")).select(*df.columns, "subset")


def split_by_manifest(df: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows whose key the manifest names, with its subset; keys named twice must agree."""
    one = manifest.groupBy(key).agg(F.when(F.min("subset") == F.max("subset"), F.min("subset")).alias("subset"))
    return df.join(one, key)


def cap_group(rows: DataFrame, group: str, label: str, cap: int, key: Column, seed: int = 13) -> DataFrame:
    """At most ``cap`` rows of a group: all positives first, then negatives by chance (a sampling operator)."""
    marked = rows.withColumn("_c", chance(key, seed))
    positive = F.coalesce(F.col(label) == 1, F.lit(False))
    taken = marked.where(positive).groupBy(group).agg(F.count("*").alias("_taken")).withColumnRenamed(group, "_of")
    rest = _ranked(marked.where(~positive), group, "_c", "_c").join(taken, F.col(group).eqNullSafe(F.col("_of")), "left")
    kept = rest.where(F.col("_r") + F.coalesce("_taken", F.lit(0)) <= cap)
    return marked.where(positive).select(*rows.columns).unionByName(kept.select(*rows.columns))


def balance(rows: DataFrame, action: str, key: str, cap: int, repeated: str, seed: int = 7) -> DataFrame:
    """At most ``cap`` rows per action; the rows of ``repeated`` are repeated up to half of ``cap`` (a sampling operator)."""
    r = _ranked(rows.withColumn("_c", chance(F.col(key), seed)), action, "_c", key)
    want = F.when(F.col(action) == repeated, F.least(F.lit(cap), F.greatest(F.col("_n"), F.lit(cap // 2)))).otherwise(F.least(F.lit(cap), F.col("_n")))
    copies = F.ceil((want - F.col("_r") + 1) / F.col("_n")).cast("int")
    each = F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))
    return r.withColumn("copy", each).select(*rows.columns, "copy")


def every_nth(rows: DataFrame, doc: str, order: str, n: int = 5) -> DataFrame:
    """``doc`` of the documents that hold an nth row (each ``n`` rows from their first on)."""
    place = F.row_number().over(W.partitionBy(doc).orderBy(order)) - 1
    return rows.select(doc, place.alias("_k")).where((F.col("_k") % n == 0) & (F.col("_k") > 0)).select(doc).distinct()


def multi_hot(flags: Column, names: list[str]) -> Column:
    """``array<int>``: 1 where a flag is among them."""
    return F.array(*[F.array_contains(flags, n).cast("int") for n in names])


def corrupted(rows: DataFrame, text: str) -> DataFrame:
    """Each text of three or more words without its first and without its last one: column ``corrupt``, ``cut``."""
    words = F.split(F.trim(F.col(text)), r"\s+")
    both = F.array(F.struct(F.lit("head").alias("cut"), F.array_join(F.slice(words, 2, F.size(words) - 1), " ").alias("corrupt")), F.struct(F.lit("tail").alias("cut"), F.array_join(F.slice(words, 1, F.size(words) - 1), " ").alias("corrupt")))
    return rows.where(F.size(words) >= 3).select("*", F.inline(both))


def reference_diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """``key, action``: KEEP where both references have a span, DROP where only the first, ADD where only the second."""
    l, r = a.select(*key).distinct().withColumn("l", F.lit(1)), b.select(*key).distinct().withColumn("r", F.lit(1))
    action = F.when(F.col("l").isNull(), "ADD").when(F.col("r").isNull(), "DROP").otherwise("KEEP")
    return l.join(r, key, "full").select(*key, action.alias("action"))


# How sure each kind of training row is.
SURE, LIKELY, SYNTHETIC, UNKNOWN = 1.0, 0.5, 0.25, 0.0


def verifier_rows(first: DataFrame, second: DataFrame, model: DataFrame | None = None, drop: Column | None = None) -> DataFrame:
    """``doc_id, start, end, type, text, action, target_start, target_end, weight`` of two references and a model's spans.

    KEEP where both references have a span. Each other span of the first, in order of place, is to be
    ADJUSTed to the unused span of its type in the second that it overlaps most (the later of equals),
    or DROPped; spans of the second that are left are to KEEP. Spans that only the model has are to
    DROP where ``drop`` names a reason, else to REVIEW.
    """
    key = ["doc_id", "start", "end", "type", "text"]
    a, b = first.select(*key).distinct(), second.select(*key).distinct()
    place = [F.col("start").alias("target_start"), F.col("end").alias("target_end")]
    none = [F.lit(None).cast("int").alias("target_start"), F.lit(None).cast("int").alias("target_end")]
    kept = a.join(b, key, "left_semi").select(*key, F.lit("KEEP").alias("action"), *place, F.lit(SURE).alias("weight"))
    only = a.join(b, key, "left_anti").withColumn("side", F.lit(0)).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit(1)))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start", "end", "type", "text"], kind="stable")
        right = [r for r in rows[rows["side"] == 1].itertuples(index=False)]
        by_type: dict[str, list[int]] = {}
        for i, r in enumerate(right):
            by_type.setdefault(r.type, []).append(i)
        used, out = set(), []
        for r in rows[rows["side"] == 0].itertuples(index=False):
            near = [(min(r.end, right[i].end) - max(r.start, right[i].start), i) for i in by_type.get(r.type, []) if i not in used]
            best = max((x for x in near if x[0] > 0), default=None)
            if best:
                used.add(best[1])
                out.append((*r[:5], "ADJUST", right[best[1]].start, right[best[1]].end))
            else:
                out.append((*r[:5], "DROP", None, None))
        out += [(*r[:5], "KEEP", r.start, r.end) for i, r in enumerate(right) if i not in used]
        made = pd.DataFrame(out, columns=[*key, "action", "target_start", "target_end"])
        return made.astype({"target_start": "Int32", "target_end": "Int32"})

    kind = {f.name: f.dataType.simpleString() for f in a.schema}
    schema = ", ".join([*(f"{c} {kind[c]}" for c in key), "action string", "target_start int", "target_end int"])
    rows = kept.unionByName(only.groupBy("doc_id").applyInPandas(match, schema).withColumn("weight", F.lit(LIKELY)))
    if model is None:
        return rows
    extra = model.join(a, key, "left_anti").join(b, key, "left_anti")
    said = (drop if drop is not None else F.lit(None).cast("string")).isNotNull()
    return rows.unionByName(extra.select(*key, F.when(said, "DROP").otherwise("REVIEW").alias("action"), *none, F.when(said, SURE).otherwise(UNKNOWN).alias("weight")).distinct())


def training_pairs(pools: DataFrame, gold: DataFrame) -> DataFrame:
    """``qid, code, label``: the codes of each pool and the gold code (qid, gold), which is added where it is missing, and NONE.

    Exactly one row of a query is positive: its gold code, or NONE where it has none.
    """
    known = gold.select("qid", "gold")
    codes = pools.where("code != 'NONE'").select("qid", "code").unionByName(known.where("gold is not null").select("qid", F.col("gold").alias("code"))).distinct()
    rows = codes.join(known, "qid").select("qid", "code", F.coalesce(F.col("code") == F.col("gold"), F.lit(False)).cast("int").alias("label"))
    return rows.unionByName(known.select("qid", F.lit("NONE").alias("code"), F.col("gold").isNull().cast("int").alias("label")))


def segment_examples(segments: DataFrame, texts: DataFrame, spans: DataFrame, policies: dict[str, str], default: str) -> DataFrame:
    """``doc_id, segment, prompt, answer``: a segment's text behind the policy of its kind, and its spans as JSON in local places.

    ``segments`` are ``doc_id, segment, s0, e0, kind``; a segment without spans is answered by an empty array.
    """
    from .intervals import contained

    inside = contained(segments, spans.select("doc_id", "start", "end", "type", "ord"))
    item = F.struct(F.col("local_start").alias("start"), F.col("local_end").alias("end"), F.col("type"))
    answers = inside.groupBy("doc_id", "segment").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("local_start", "local_end", "ord", item.alias("item")))), lambda x: x.item)).alias("answer"))
    policy = F.lit(default)
    for kind, said in policies.items():
        policy = F.when(F.col("kind") == kind, said).otherwise(policy)
    lists = segments.groupBy("doc_id").agg(F.collect_list(F.struct("segment", "s0", "e0", "kind")).alias("all")).join(texts.select("doc_id", "text"), "doc_id")
    cut = lists.select("doc_id", F.inline(F.transform("all", lambda x: F.struct(x.segment.alias("segment"), x.kind.alias("kind"), F.substring("text", x.s0 + 1, x.e0 - x.s0).alias("body")))))
    return cut.join(answers, ["doc_id", "segment"], "left").select("doc_id", "segment", F.concat(policy, F.lit("\n\n"), "body").alias("prompt"), F.coalesce("answer", F.lit("[]")).alias("answer"))


def weighted_pick(key: Column, weights: dict[str, float], seed: int = 3) -> Column:
    """A name by chance, as often as its weight says."""
    u = F.conv(F.substring(chance(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    total, at, out = sum(weights.values()), 0.0, F.lit(None).cast("string")
    for name, w in weights.items():
        at += w / total
        out = F.when(out.isNull() & (u < at), name).otherwise(out)
    return F.coalesce(out, F.lit(list(weights)[-1]))


def char_tags(length: Column, spans: Column) -> Column:
    """``array<string>``: O, B-x or I-x for each character, from spans ``array<struct<start, end, type>>`` that don't overlap."""

    def tag(i: Column) -> Column:
        over = F.get(F.filter(spans, lambda s: (s.start <= i) & (i < s.end)), F.lit(0))
        return F.when(over.isNull(), "O").otherwise(F.concat(F.when(over.start == i, "B-").otherwise("I-"), over.type))

    return F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1), tag)).otherwise(F.array().cast("array<string>"))


def token_labels(tags: Column, starts: Column, padded: int) -> Column:
    """``array<string>``: labels of tokens from the tag of their first character, filled up with -100."""
    known = F.transform(starts, lambda s: F.element_at(tags, s + 1).cast("string"))
    return F.concat(known, F.array_repeat(F.lit("-100"), F.greatest(F.lit(0), F.lit(padded) - F.size(starts))))
