"""Shared plumbing: scratch tables in the cluster's shared folder, unique column names, decided rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch between Spark and a Python worker, at most: long texts would make batches of hundreds of MB.
BATCH, _BATCH_KEY = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_ROOTS: dict[str, str] = {}
_OWN: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder for this application's intermediate tables.

    It lies in ``spark.checkpoint.dir``, which all executors share. Only where that is unset and
    Spark runs in one process (tests) a temporary folder of this machine is taken.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        _ROOTS[app] = f"{shared.rstrip('/')}/spanloom-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _ROOTS[app])
    return _ROOTS[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


class Scratch:
    """Intermediate tables of one operator call; :meth:`drop` removes those nobody reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        if int(spark.conf.get(_BATCH_KEY).rstrip("b")) > BATCH:
            spark.conf.set(_BATCH_KEY, str(BATCH))
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back: cuts the lineage, survives lost executors, is computed once."""
        self.n += 1
        at = f"{self.path}/{self.n}"
        df.write.mode("overwrite").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch = at
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table made by :meth:`keep`."""
        _drop(self.spark, df._scratch)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def columns_of(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under the operator's own names: clashing extra columns are left out.

    ``wanted`` maps the operator's name to the caller's; a name with dots or blanks is taken literally.
    """
    from pyspark.sql import functions as F

    return df.select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in wanted.items()])
