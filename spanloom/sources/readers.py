"""Readers: raw notes, entity JSON, JSON lines and pipe-delimited catalogues, all through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("position", T.ArrayType(T.IntegerType())), T.StructField("type", T.StringType()),
    T.StructField("assertions", T.ArrayType(T.StringType())), T.StructField("candidates", T.ArrayType(T.StringType())),
])
# The columns of a pipe-delimited concept file and the kinds of names kept from it, best first.
CONCEPT_COLUMNS = ("RXCUI", "LAT", "TS", "LUI", "STT", "SUI", "ISPREF", "RXAUI", "SAUI", "SCUI", "SDUI", "SAB", "TTY", "CODE", "STR", "SRL", "SUPPRESS", "CVF")
NAME_KINDS = ("SCD", "PSN", "SBD", "SY", "TMSY", "SCDC", "SBDC", "BN", "SCDF", "SBDF", "IN", "PIN", "MIN", "SCDG", "SBDG", "SCDGP", "SBDFP", "SCDFP")
RESERVED = ("reference", "gold_reference", "reserved_reference")


def check_source(path: str) -> str:
    """The path, unless a part of it is reserved for references."""
    if set(path.replace("\\", "/").split("/")) & set(RESERVED):
        raise ValueError(f"{path} holds reserved references")
    return path


def read_notes(spark: SparkSession, path: str, line_ends: str = "kept") -> DataFrame:
    """``doc_id, text``: one row per file; the id is the file's name without ending.

    Line ends stay as they are, so places are those of the file. With ``line_ends="translated"`` every
    kind of them becomes a line feed, as a reader in text mode gives them; places then differ.
    """
    if line_ends not in ("kept", "translated"):
        raise ValueError(f"line_ends is kept or translated, not {line_ends}")
    files = spark.read.text(check_source(path), wholetext=True)
    text = F.col("value") if line_ends == "kept" else F.regexp_replace("value", "\r\n?", "\n")
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), text.alias("text"))


def paired(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, text`` and the columns of spans for documents that have both; a span beyond its text is an error."""
    both = texts.select("doc_id", F.length("text").alias("n")).join(spans, "doc_id")
    fits = F.when((F.col("end") > F.col("n")) | (F.col("start") < 0), F.raise_error(F.concat(F.lit("a span lies beyond the text of "), F.col("doc_id").cast("string")))).otherwise(F.lit(True))
    return both.where(fits).select(*spans.columns)


#: Characters of a dictionary file, at most: it is parsed in one piece.
DICTIONARY = 16 << 20


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``section, phrase, payload`` of a YAML dictionary: lists of phrases, or phrases with a payload (as JSON), by section.

    Such files are small and are parsed in one piece; a larger one than ``DICTIONARY`` is an error.
    """
    import json

    import yaml

    body = spark.read.text(check_source(path), wholetext=True).first()["value"]
    if len(body) > DICTIONARY:
        raise ValueError(f"{path} is too long for a dictionary")
    rows: list[tuple[str, str, str | None]] = []
    for section, items in (yaml.safe_load(body) or {}).items():
        if isinstance(items, dict):
            rows += [(section, str(k), json.dumps(v, ensure_ascii=False)) for k, v in items.items()]
        elif isinstance(items, list):
            rows += [(section, str(x.get("phrase") or next(iter(x.values()))), json.dumps(x, ensure_ascii=False)) if isinstance(x, dict) else (section, str(x), None) for x in items]
        else:
            rows.append((section, str(items), None))
    return spark.createDataFrame(rows, "section string, phrase string, payload string")


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, ord, text, start, end, type, assertions, candidates`` from one JSON array per file."""
    files = spark.read.text(check_source(path), wholetext=True)
    rows = files.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), F.posexplode(F.from_json("value", T.ArrayType(SPAN))).alias("ord", "s"))
    return rows.select("doc_id", "ord", "s.text", F.get("s.position", F.lit(0)).alias("start"), F.get("s.position", F.lit(1)).alias("end"), "s.type", F.coalesce("s.assertions", F.array().cast("array<string>")).alias("assertions"), F.coalesce("s.candidates", F.array().cast("array<string>")).alias("candidates"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON-lines file; blank lines give none."""
    return spark.read.schema(schema).json(check_source(path)).dropna(how="all")


def read_concepts(spark: SparkSession, path: str, source: str = "RXNORM") -> DataFrame:
    """``rxcui, tty, name, suppress, prio`` of a pipe-delimited concept file."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in CONCEPT_COLUMNS])
    raw = spark.read.csv(path, sep="|", schema=schema, quote="", mode="PERMISSIVE")
    kept = raw.where((F.col("SAB") == source) & F.col("TTY").isin(*NAME_KINDS))
    prio = F.array_position(F.array(*[F.lit(k) for k in NAME_KINDS]), F.col("TTY")) - 1
    return kept.select(F.col("RXCUI").alias("rxcui"), F.col("TTY").alias("tty"), F.col("STR").alias("name"), F.coalesce("SUPPRESS", F.lit("")).alias("suppress"), prio.cast("int").alias("prio"))


def text_of(value, names: tuple[str, ...] = ("text", "content", "input", "document")):
    """The text in a JSON value: the string itself, or the first of the named fields."""
    fields = [F.get_json_object(value, f"$.{n}") for n in names]
    return F.coalesce(*fields, F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string").getField("v"))


def read_versioned(spark: SparkSession, path: str, version: str) -> DataFrame:
    """A table written by :func:`spanloom.sources.writers.write_versioned`; another version is an error."""
    found = spark.read.parquet(f"{path}/_meta_version").first()["version"]
    if found != version:
        raise ValueError(f"{path} has version {found}, not {version}")
    return spark.read.parquet(f"{path}/data")
