"""Incremental ingest: only files not seen before are processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.operators.clean import clean
from farebox.operators.dims import build_dimensions, upsert_dim
from farebox.session import scratch
from farebox.sources.facts import write_validations
from farebox.sources.raw import read_raw_csv
from farebox.sources.reference import read_dim
from farebox.sources.sinks import DIMS, current_dims, dim_versions, publish_dims

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


# Files of one micro-batch: what the driver lists and one cleaning job takes in.
FILES_PER_BATCH = 1000


def refresh_dims(spark: SparkSession, named: DataFrame, folder: str, version: int) -> None:
    """Merge the dimensions of new rows into those below ``folder``, as its next version; new values win.

    A version that is complete stays as it is, so a batch that is replayed changes nothing.
    """
    if version in dim_versions(spark, folder):
        return
    before = current_dims(spark, folder)
    merged = []
    for (name, key, value, kind), new in zip(DIMS, build_dimensions(named)):
        old = read_dim(spark, f"{before}/{name}", kind).toDF(key, value)
        merged.append(upsert_dim(old, new, key, value))
    publish_dims(spark, tuple(merged), folder, version)


def ingest_incremental(
    spark: SparkSession, source: str, table: str, checkpoint: str, mode: str = "parity", dims: str | None = None,
    files_per_batch: int = FILES_PER_BATCH,
) -> None:
    """Process all new CSV files below ``source`` and stop.

    The stream only lists files (their content isn't read by it); its checkpoint is the list of
    finished ones. Each micro-batch takes ``files_per_batch`` of them at most, reads them by column
    name, cleans them as one set and writes them under its own ``carga`` below each day: a batch that
    is replayed after a failure replaces exactly its own output. With ``dims`` the dimensions there
    get a new version (see :func:`farebox.sources.sinks.current_dims`).
    """
    def process(batch: DataFrame, number: int) -> None:
        files = [row.path for row in batch.select("path").collect()]
        if not files:
            return
        with scratch(spark):
            named = clean(read_raw_csv(spark, files), mode)
            write_validations(named, table, load=number + 1, laid_out=True)
            if dims is not None:
                refresh_dims(spark, named, dims, number + 1)

    listing = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    query = (
        listing.load(source).select(F.col("path")).writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
