"""Writers: one JSON array per document, JSON lines, versioned tables, and a checked package."""

from __future__ import annotations

import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.validate import completeness


def write_json_rows(rows: DataFrame, path: str, partitions: int | None = None) -> None:
    """``doc_id, json`` as text lines ``doc_id TAB json``."""
    out = rows.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "json").alias("value"))
    (out.repartition(partitions, "value") if partitions else out).write.mode("overwrite").text(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_versioned(rows: DataFrame, path: str, version: str) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/data")
    rows.sparkSession.createDataFrame([(version,)], "version string").write.mode("overwrite").parquet(f"{path}/_meta_version")


def append_log(row: DataFrame, path: str) -> None:
    row.write.mode("append").json(path)


def write_package(rows: DataFrame, expected: DataFrame, path: str) -> int:
    """A zip with ``<doc_id>.json`` for exactly the expected ids, in their order; the same rows give the same bytes.

    Rows are fetched one partition at a time, as a package is one file on the driver.
    """
    wrong = completeness(expected, rows, "doc_id").limit(20).collect()
    if wrong:
        raise ValueError(f"not a whole package: {[(r['doc_id'], r['problem']) for r in wrong]}")
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for r in rows.select("doc_id", "json").orderBy("doc_id").toLocalIterator():
            z.writestr(zipfile.ZipInfo(f"{r['doc_id']}.json", (1980, 1, 1, 0, 0, 0)), r["json"])
            n += 1
    with zipfile.ZipFile(path) as z:
        if z.testzip() or len(z.namelist()) != n:
            raise ValueError(f"{path} doesn't read back")
    return n
