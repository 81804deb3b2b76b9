"""Result outputs. Spark's commit protocol writes to a temporary place and renames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farebox.session import at_once, hadoop_path

# Dimension tables: folder, key, value and type of the value.
DIMS = [
    ("dim_linea", "codigo_linea", "nombre_linea", "string"),
    ("dim_estacion", "codigo_estacion", "nombre_estacion", "string"),
    ("linea_estaciones", "codigo_linea", "estaciones", "array<long>"),
]


def write_result_json(df: DataFrame, path: str) -> None:
    """A small result table (KPIs, one row per line or station) as one JSON file.

    The rows are gathered after they were computed, so only the result goes to one task.
    """
    df.repartition(1).write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_dims(lines: DataFrame, stations: DataFrame, line_stations: DataFrame, path: str) -> None:
    """The three dimension tables as JSON lines below one folder."""
    def job(name, key, value, df):
        return lambda: write_result_json(df.select(key, value), f"{path}/{name}")

    at_once(*[job(name, key, value, df) for (name, key, value, _), df in zip(DIMS, (lines, stations, line_stations))])


READY = "_READY"


def dim_versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions of the dimensions below ``folder``, ascending."""
    fs, root = hadoop_path(spark, folder)
    found = fs.listStatus(root) if fs.exists(root) else []
    names = [str(entry.getPath().getName()) for entry in found]
    numbers = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
    return [n for n in numbers if fs.exists(hadoop_path(spark, f"{folder}/v{n}/{READY}")[1])]


def current_dims(spark: SparkSession, folder: str) -> str:
    """Where the newest complete version is; the folder itself where there are no versions."""
    versions = dim_versions(spark, folder)
    return f"{folder}/v{versions[-1]}" if versions else folder


def publish_dims(spark: SparkSession, tables: tuple[DataFrame, ...], folder: str, version: int) -> None:
    """Write the three tables as a version of their own, which counts from the moment it is complete.

    A reader sees one version or the next, never a part of each. The version before stays for
    readers that began with it; older ones are deleted.
    """
    path = f"{folder}/v{version}"
    write_dims(*tables, path)
    fs, ready = hadoop_path(spark, f"{path}/{READY}")
    fs.create(ready, True).close()
    for old in dim_versions(spark, folder)[:-2]:
        fs.delete(hadoop_path(spark, f"{folder}/v{old}")[1], True)
