"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that change results or plans; everything about cluster size is left to spark-submit.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str = "farebox", cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    width = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(width))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in SQL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster.

    Only where driver and tasks are one process may it be missing: a private folder is used
    then. On a cluster every executor would write to its own disk, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        current = tempfile.mkdtemp(prefix="farebox-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as Spark itself would open it: (file system, path)."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


# Folders written since the innermost scratch() of this thread or task began; None outside of one.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what :func:`materialize` writes inside the block when it ends.

    For jobs that write their results before the block ends; a lazy result must not leave it.
    Blocks of other threads are apart.
    """
    written: list[str] = []
    before = _SCRATCH.set(written)
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        for path in written:
            fs, folder = hadoop_path(spark, path)
            fs.delete(folder, True)


def at_once(*jobs: Callable[[], None]) -> None:
    """Run independent Spark jobs side by side; the first failure is raised when all have ended."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(copy_context().run, job) for job in jobs]
    for job in running:
        job.result()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows once to the shared checkpoint folder and read them back.

    Several outputs then share one computation, a lost executor costs a re-read only, and
    later steps read just the columns they need. Inside :func:`scratch` the folder goes with
    the block, else it is the cluster's to clean.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/farebox-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCRATCH.get() is not None:
        _SCRATCH.get().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row global aggregate to every row.

    ``one_row`` must come from an aggregate without keys: one row is the size bound that
    makes the broadcast safe at any scale.
    """
    return df.join(F.broadcast(one_row))


def literal_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small table of constants, visible to the optimizer with its true size.

    ``columns`` is a DDL string such as ``"code long, name string"``.
    """
    schema = [part.strip().split(" ", 1) for part in columns.split(",")]

    def lit(value, kind):
        return F.lit(value).cast(kind)

    structs = [
        F.struct(*[lit(v, kind).alias(name) for v, (name, kind) in zip(row, schema)]) for row in rows
    ]
    if not structs:
        return spark.createDataFrame([], columns)
    return spark.range(1).select(F.inline(F.array(*structs)))
