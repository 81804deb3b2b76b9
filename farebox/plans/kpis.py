"""KPI tables. One pre-aggregate feeds them all, so the fact table is scanned once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.functions.calendar import with_hours
from farebox.functions.text import dotted_thousands, hour_band
from farebox.operators.dims import first_line_of_station, named, with_aliases
from farebox.operators.panels import sum_by, top_overall, top_per_group
from farebox.schemas import MANUAL_STATION_NAMES, STATION_ALIASES
from farebox.session import literal_table, materialize, scratch
from farebox.sources.sinks import write_result_json

LINE_FALLBACK, STATION_FALLBACK = "Línea %s", "Estación %s"


def pre_aggregate(facts: DataFrame) -> DataFrame:
    """Totals by line, station, date and hour: the input of every KPI."""
    return with_hours(facts).groupBy("codigo_linea", "codigo_estacion", "fecha", "hora_int").agg(
        F.sum("entradas").alias("entradas"), F.sum("salidas").alias("salidas"), F.sum("total").alias("total")
    )


def mean_daily(facts: DataFrame) -> DataFrame:
    """Mean of daily totals, with its dotted text (the fraction is cut, not rounded)."""
    mean = sum_by(facts, ["fecha"]).agg(F.avg("total").alias("promedio_diario"))
    checked = F.coalesce("promedio_diario", F.raise_error(F.lit("sin validaciones: primero hay que cargar la tabla de hechos")).cast("double"))
    return mean.select(checked.alias("promedio_diario"), dotted_thousands(checked).alias("texto"))


def top_line(facts: DataFrame, lines: DataFrame) -> DataFrame:
    top = top_overall(sum_by(facts, ["codigo_linea"]), "codigo_linea")
    return named(top, lines, "codigo_linea", "nombre_linea", LINE_FALLBACK)


def peak_hour(facts: DataFrame) -> DataFrame:
    top = top_overall(sum_by(with_hours(facts), ["hora_int"]), "hora_int")
    return top.withColumn("franja", hour_band("hora_int"))


def top_station(facts: DataFrame, stations: DataFrame) -> DataFrame:
    top = top_overall(sum_by(facts, ["codigo_estacion"]), "codigo_estacion")
    return named(top, stations, "codigo_estacion", "nombre_estacion", STATION_FALLBACK)


def station_names(spark: SparkSession, layer: DataFrame | None = None) -> DataFrame:
    """Manually known names, overridden by the station layer where it has the code."""
    manual = literal_table(spark, MANUAL_STATION_NAMES, "codigo_estacion long, nombre_estacion string")
    if layer is None:
        return manual
    known = layer.select("codigo_estacion", "nombre_estacion").dropDuplicates(["codigo_estacion"])
    return manual.join(known.select("codigo_estacion"), "codigo_estacion", "left_anti").unionByName(known)


def line_table(facts: DataFrame, lines: DataFrame, stations: DataFrame) -> DataFrame:
    """Total per line with its main station; totals cover boardings and alightings."""
    pairs = sum_by(facts, ["codigo_linea", "codigo_estacion"])
    total = sum_by(pairs, ["codigo_linea"], name="total_linea")
    top = top_per_group(pairs, "codigo_linea", "codigo_estacion", "total")
    table = total.join(top, "codigo_linea", "left")
    table = named(table, lines, "codigo_linea", "nombre_linea", LINE_FALLBACK)
    table = named(table, stations, "codigo_estacion", "nombre_estacion", STATION_FALLBACK)
    return table.select(
        "codigo_linea", F.col("nombre_linea").alias("Linea"), F.col("nombre_estacion").alias("Top_Estacion"),
        dotted_thousands("total_linea").alias("Entradas"), "total_linea",
    )


def station_stats(facts: DataFrame, line_lists: DataFrame, lines: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Boardings, mean per day with data and line name of each station, also under alias codes."""
    # Days are made distinct by grouping first: no state ever lists the days of a station.
    per_day = facts.groupBy("codigo_estacion", "fecha").agg(F.sum("entradas").alias("entradas"))
    stats = per_day.groupBy("codigo_estacion").agg(
        F.sum("entradas").alias("total_entradas"), F.count("fecha").alias("n_dias")
    )
    stats = stats.join(first_line_of_station(line_lists), "codigo_estacion", "left")
    stats = named(stats, lines, "codigo_linea", "nombre_linea", LINE_FALLBACK).select(
        "codigo_estacion",
        F.when(F.col("codigo_linea").isNull(), "").otherwise(F.col("nombre_linea")).alias("nombre_linea"),
        F.round(F.col("total_entradas") / F.col("n_dias")).cast("long").alias("promedio_diario"),
        "total_entradas",
    )
    if aliases is None:
        aliases = literal_table(facts.sparkSession, STATION_ALIASES, "codigo_estacion long, alias long")
    return with_aliases(stats, aliases)


KPI_TABLES = ["promedio_diario", "linea_principal", "hora_pico", "estacion_principal", "tabla_troncales", "estacion_stats"]


def run(facts: DataFrame, lines: DataFrame, line_lists: DataFrame, stations: DataFrame, out: str) -> None:
    """All KPI results as JSON below ``out``, one folder each (``KPI_TABLES``).

    The facts are scanned once, for the pre-aggregate; it is written to the checkpoint folder, read
    by every KPI and deleted at the end. ``lines`` and ``stations`` are (code, name), ``line_lists``
    the stations of each line.
    """
    with scratch(facts.sparkSession):
        totals = materialize(pre_aggregate(facts))
        tables = [
            mean_daily(totals), top_line(totals, lines), peak_hour(totals), top_station(totals, stations),
            line_table(totals, lines, stations), station_stats(totals, line_lists, lines),
        ]
        for name, table in zip(KPI_TABLES, tables):
            write_result_json(table, f"{out}/{name}")


def period_counts(daily_weather: DataFrame) -> DataFrame:
    """Days, rainy days and their share, and mean rain of rainy and dry days."""
    rain = F.col("rain_day") == 1
    return daily_weather.agg(
        F.count("*").alias("n_dias"),
        F.sum(F.when(rain, 1).otherwise(0)).alias("n_lluvia"),
        (F.avg("rain_day") * 100).alias("pct_lluvia"),
        F.avg(F.when(rain, F.col("precip_sum"))).alias("precip_lluvia"),
        F.avg(F.when(~rain, F.col("precip_sum"))).alias("precip_seco"),
        F.min("temp_mean").alias("temp_min"), F.max("temp_mean").alias("temp_max"), F.avg("temp_mean").alias("temp_media"),
    )


def price_range(fuel: DataFrame) -> DataFrame:
    """Extremes, relative range, distinct levels of the monthly price."""
    return fuel.agg(
        F.min("precio_cop_gal").alias("precio_min"), F.max("precio_cop_gal").alias("precio_max"),
        (F.max("precio_cop_gal") / F.min("precio_cop_gal") - 1).alias("variacion"),
        F.countDistinct("precio_cop_gal").alias("niveles"),
    )
