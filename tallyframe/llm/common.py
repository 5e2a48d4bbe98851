"""Shared plumbing of the subpackage: the cluster's shared folder and tables written to it."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting (as in tests) gets a temporary folder; a cluster
    without it is an error, since a machine-local folder would not outlive an executor.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tallyframe-")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: computed once, lineage cut."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(df: DataFrame) -> None:
    """Remove the files of a DataFrame made by :func:`written` that nothing will read any more."""
    remove_paths(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def remove_paths(spark: SparkSession, paths: set[str] | list[str]) -> None:
    """Delete folders below the shared folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def for_every_id(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``found`` with a row for each id of ``rows`` (a null id has none): one without a match is a group
    of its own without links. Both have the id in their first column; ``found`` has group_id and links."""
    i = found.columns[0]
    ids = rows.select(F.col(f"`{i}`").cast("long").alias(i)).where(F.col(i).isNotNull()).distinct()
    out = ids.join(found, i, "left")
    return out.withColumns({"group_id": F.coalesce("group_id", i), "links": F.coalesce("links", F.lit(0).cast("long"))})


def give_back() -> None:
    """Return a worker's freed memory to the system: workers are used again, and what one stage's
    allocator keeps counts against the next stage's executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Tables written inside go to Python in Arrow batches of so many rows: with texts or blobs in them, the
    usual 10,000 rows are tens of MB, held by JVM and worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
