"""Line and station dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.functions.text import head_to_portal, normalize_name
from farebox.session import materialize


def name_counts(df: DataFrame, code: str, name: str) -> DataFrame:
    """How often each (code, name) pair occurs."""
    return df.groupBy(code, name).agg(F.count("*").alias("len"))


def normalized_counts(counts: DataFrame, code: str, name: str, portal: bool = False) -> DataFrame:
    """Normalise names after counting: the text work touches distinct names, not rows."""
    text = normalize_name(name)
    text = head_to_portal(text) if portal else text
    return counts.groupBy(code, text.alias(name)).agg(F.sum("len").alias("len"))


def most_frequent_name(counts: DataFrame, code: str, name: str) -> DataFrame:
    """The most frequent name of each code; equal counts are settled by name.

    An ordered-struct maximum instead of a window: it combines before the shuffle, so a code
    with very many spellings never gathers in one task. The name is compared by a descending
    key through ``min`` on (-count, name).
    """
    best = F.min(F.struct((-F.col("len")).alias("neg"), F.col(name).alias("name")))
    return counts.groupBy(code).agg(best.alias("b")).select(code, F.col("b.name").alias(name))


def line_stations(df: DataFrame) -> DataFrame:
    """Distinct stations of each line as a sorted list."""
    pairs = df.select("codigo_linea", "codigo_estacion").distinct()
    return pairs.groupBy("codigo_linea").agg(F.sort_array(F.collect_list("codigo_estacion")).alias("estaciones"))


def station_lines(line_station_lists: DataFrame) -> DataFrame:
    """Bridge table station x line from the lists."""
    return line_station_lists.select("codigo_linea", F.explode("estaciones").alias("codigo_estacion"))


def first_line_of_station(line_station_lists: DataFrame) -> DataFrame:
    """The first line, by code, that lists a station."""
    return station_lines(line_station_lists).groupBy("codigo_estacion").agg(F.min("codigo_linea").alias("codigo_linea"))


def upsert_dim(old: DataFrame, new: DataFrame, key: str, value: str, mode: str = "parity") -> DataFrame:
    """Merge two versions of a dimension: new values win, old-only keys stay.

    ``parity`` replaces list values too; ``union`` joins the two lists.
    """
    o, n = old.select(key, F.col(value).alias("_old")), new.select(key, F.col(value).alias("_new"))
    merged = F.coalesce("_new", "_old")
    if mode == "union":
        none = F.array().cast(dict(new.dtypes)[value])
        merged = F.sort_array(F.array_union(F.coalesce("_old", none), F.coalesce("_new", none)))
    elif mode != "parity":
        raise ValueError(f"unknown mode {mode!r}")
    return o.join(n, key, "full_outer").select(key, merged.alias(value))


def build_dimensions(named: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Line names, station names and stations per line from cleaned rows that carry names.

    One pass counts the distinct combinations of labels; the three tables come from that
    small count table.
    """
    return dimensions_of(
        named.groupBy("codigo_linea", "nombre_linea", "codigo_estacion", "nombre_estacion").agg(F.count("*").alias("len"))
    )


def dimensions_of(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables from the counts of codes and names."""
    counts = materialize(counts)

    def names(code: str, name: str, portal: bool) -> DataFrame:
        return most_frequent_name(normalized_counts(counts, code, name, portal), code, name)

    return (
        names("codigo_linea", "nombre_linea", False),
        names("codigo_estacion", "nombre_estacion", True),
        line_stations(counts),
    )


def named(df: DataFrame, names: DataFrame, code: str, name: str, fallback: str) -> DataFrame:
    """Attach names by code, with ``fallback`` (a format taking the code) for unknown codes."""
    lookup = names.select(F.col(code), F.col(name).alias("_name"))
    text = F.coalesce("_name", F.format_string(fallback, F.col(code).cast("string")))
    return df.join(lookup, code, "left").withColumn(name, text).drop("_name")


def with_aliases(stats: DataFrame, aliases: DataFrame) -> DataFrame:
    """Copy rows under a second code; the copy replaces a row that already has that code.

    ``aliases`` has (codigo_estacion, alias). One pass: every row is listed under its own code and
    its aliases, and of the rows with one code a copy wins; among copies that of the smallest code.
    """
    lists = aliases.groupBy("codigo_estacion").agg(F.collect_set("alias").alias("_aliases"))
    rest = [c for c in stats.columns if c != "codigo_estacion"]
    code = F.col("codigo_estacion")
    own = F.array(F.struct(F.lit(1).alias("own"), code.alias("code")))
    copies = F.transform(F.coalesce("_aliases", F.array().cast("array<bigint>")), lambda a: F.struct(F.lit(0).alias("own"), a.alias("code")))
    listed = stats.join(lists, "codigo_estacion", "left").withColumn("_to", F.explode(F.concat(own, copies)))
    ranked = F.struct(F.col("_to.own"), code.alias("from"), *rest)
    best = listed.groupBy(F.col("_to.code").alias("_code")).agg(F.min(ranked).alias("_b"))
    return best.select(F.col("_code").alias("codigo_estacion"), *[F.col(f"_b.{c}").alias(c) for c in rest]).select(*stats.columns)
