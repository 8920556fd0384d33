"""What the operators share on the cluster: scratch tables, numbers of rows, sizes of work units."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks of one shuffle, at most. What runs in a task holds one unit at a time, so this bounds parallelism, not what is done.
MOST_TASKS = 20_000
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where it is unset only a local master, as in tests, gets one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/tessella-scratch-{spark.sparkContext.applicationId}"


#: Tables of `materialize` that are still there: thread, scratch folder, path.
_HELD: list[tuple[int, str, str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the scratch folder: cuts the lineage, is computed once and outlives executors. It stays until `release`."""
    folder = scratch_dir(df.sparkSession)
    path = f"{folder}/table-{uuid.uuid4().hex}"
    _HELD.append((threading.get_ident(), folder, path))
    return _write(df, path)


def release(spark: SparkSession, keep: DataFrame | None = None) -> None:
    """Deletes what `materialize` has made in this thread, but for the tables that keep reads. What else is made of them must be written before."""
    folder, read = scratch_dir(spark), "\n".join(keep.inputFiles()) if keep is not None else ""
    for entry in [e for e in _HELD if e[:2] == (threading.get_ident(), folder) and e[2].rsplit("/", 1)[1] not in read]:
        delete(spark, entry[2])
        _HELD.remove(entry)


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that only one computation needs: all are deleted when the block ends. What it returns must be materialized before.

    Within the block Arrow batches hold BATCH_ROWS rows at most; the session's own setting returns at its end.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{scratch_dir(spark)}/work-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        self.before = self.spark.conf.get(_BATCH)
        self.spark.conf.set(_BATCH, str(BATCH_ROWS))
        return self

    def table(self, df: DataFrame) -> DataFrame:
        return _write(df, f"{self.path}/{uuid.uuid4().hex}")

    def __exit__(self, *_) -> None:
        self.spark.conf.set(_BATCH, self.before)
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder by Spark's own file system, so any store will do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(name: str, columns: list[str]) -> str:
    """name, with as many _ after it as it takes to clash with no column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, str]:
    """docs as a table (of scratch, if given) with a number of its own for every row, and that column's name. Written once, so the numbers stay."""
    row = fresh("_row", docs.columns)
    return (scratch.table if scratch else materialize)(docs.withColumn(row, F.monotonically_increasing_id())), row


def without(docs: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """A numbered table without the rows whose number is in gone (column row), and without the numbers. One plan at every size: a merge join on unique numbers."""
    return docs.join(gone.select(F.col("row").alias(row)).hint("merge"), row, "left_anti").drop(row)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a column, by one column scan."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("b")).first()["b"]


def units(spark: SparkSession, amount: float, each: float) -> int:
    """Work units of about `each`, and no fewer than the shuffle's partitions."""
    return max(partitions(spark), int(amount // each) + 1)


def tasks(spark: SparkSession, n_units: int) -> int:
    """Tasks of a shuffle by unit: one a unit up to MOST_TASKS, then several units a task, one after the other."""
    return max(partitions(spark), min(n_units, MOST_TASKS))
