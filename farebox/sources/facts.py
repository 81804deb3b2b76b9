"""The validations fact table: read, prune, write, migrate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.schemas import FACT_COLUMNS
from farebox.session import hadoop_path, materialize, scratch
from farebox.sources.raw import require_columns


def read_validations(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The fact table as one DataFrame; ``columns`` limits the scan to those columns."""
    df = spark.read.parquet(path)
    if not df.columns:
        raise RuntimeError(f"sin columnas: {path}")
    wanted = columns or FACT_COLUMNS
    return require_columns(df, wanted, path).select(*wanted)


def regroup_slots(facts: DataFrame) -> DataFrame:
    """One row for each slot where several loads brought parts of it. Sums don't need it; counts of rows do."""
    keys = ["timestamp", "fecha", "hora", "codigo_estacion"]
    sums = [F.sum(c).alias(c) for c in ("entradas", "salidas", "total")]
    return facts.groupBy(*keys).agg(F.min("codigo_linea").alias("codigo_linea"), *sums).select(*FACT_COLUMNS)


def read_dates(spark: SparkSession, path: str, dates: DataFrame, key: str = "fecha") -> DataFrame:
    """Only the rows of listed days.

    On a table partitioned by ``fecha`` the semi join prunes partitions at run time.
    """
    return read_validations(spark, path).join(dates.select(key).distinct(), key, "left_semi")


# Stations of a day are dealt over so many tasks when the table is written.
DAY_PARTS = 1


def write_validations(df: DataFrame, path: str, load: int | str = 0, day_parts: int = DAY_PARTS, laid_out: bool = False) -> None:
    """Write the eight fact columns below ``fecha=.../carga=...``; full loads are 0, stream batches count on.

    ``load`` is the number of the load, or the column that has it.

    Rows are hashed by day, so a day is one file and no sample has to be taken first. A table
    whose days outgrow a task takes ``day_parts`` over 1: then a day's stations are dealt over that
    many tasks. Rows that are ``laid_out`` that way, as the cleaning job stores them, stay where
    they are. Days of this load that are in ``df`` replace those in the table; others stay.
    """
    part = F.pmod(F.xxhash64("codigo_estacion"), F.lit(day_parts))
    columns = [c for c in FACT_COLUMNS if c != "fecha"] + ["fecha"]
    rows = df.select(*columns, (F.col(load) if isinstance(load, str) else F.lit(load)).alias("carga"))
    if not laid_out:
        rows = rows.repartition("fecha", part)
    writer = rows.sortWithinPartitions("fecha", "carga", "codigo_estacion", "timestamp").write.partitionBy("fecha", "carga")
    # In a new table there is nothing to replace, which spares the driver two moves for every day.
    fs, folder = hadoop_path(df.sparkSession, path)
    if fs.exists(folder):
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def compact_days(spark: SparkSession, path: str, day_parts: int = DAY_PARTS) -> int:
    """Make one load of every day that several loads brought in, with one row per slot; how many days those were.

    The new days are written beside the table; then each takes its day's place by two renames, so a
    reader meets a day's old files or its new ones. A run that broke off is mended by the next: days
    that it had put aside come back first. Not to be run while rows are being written.
    """
    fs, aside = hadoop_path(spark, f"{path}/_aside")
    fresh = hadoop_path(spark, f"{path}/_fresh")[1]

    def days(folder):
        return [str(e.getPath().getName()) for e in fs.listStatus(folder)] if fs.exists(folder) else []

    def move(name, source, target):
        if not fs.rename(hadoop_path(spark, f"{source}/{name}")[1], hadoop_path(spark, f"{target}/{name}")[1]):
            raise OSError(f"{name}: could not be moved from {source} to {target}")

    for name in days(aside):
        if not fs.exists(hadoop_path(spark, f"{path}/{name}")[1]):
            move(name, aside.toString(), path)
    for folder in (aside, fresh):
        fs.delete(folder, True)
    loads = spark.read.parquet(path).select("fecha", "carga").distinct()
    with scratch(spark):
        crowded = materialize(loads.groupBy("fecha").agg(F.count("*").alias("cargas"), F.max("carga").alias("carga")).where("cargas > 1"))
        if crowded.isEmpty():
            return 0
        rows = regroup_slots(read_dates(spark, path, crowded)).join(crowded.select("fecha", "carga"), "fecha")
        write_validations(rows, fresh.toString(), "carga", day_parts)
    fs.mkdirs(aside)
    named = [name for name in days(fresh) if name.startswith("fecha=")]
    for name in named:
        move(name, path, aside.toString())
        move(name, fresh.toString(), path)
    for folder in (aside, fresh):
        fs.delete(folder, True)
    return len(named)


def migrate_legacy(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split an old table that still carries names into facts and the two name counts."""
    from farebox.operators.dims import name_counts

    require_columns(df, FACT_COLUMNS + ["nombre_linea", "nombre_estacion"], "la tabla antigua")
    return (
        df.select(*FACT_COLUMNS),
        name_counts(df, "codigo_linea", "nombre_linea"),
        name_counts(df, "codigo_estacion", "nombre_estacion"),
    )
