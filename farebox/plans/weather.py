"""Weather and demand: station panel with fixed effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.functions.numeric import percent
from farebox.operators.dims import named, station_lines
from farebox.operators.panels import daily_weather, station_day
from farebox.operators.regression import OlsModel, ols_fit, ols_fits
from farebox.plans.holidays import calendar_controls

MIN_LINE_ROWS = 500


def weather_panel(facts: DataFrame, weather: DataFrame, holidays: DataFrame) -> DataFrame:
    """Positive station-days outside holidays with the weather of the day and log demand."""
    off = holidays.select(F.col("date").alias("fecha")).distinct()
    # Days are left out of the panel: it has far fewer rows than the facts.
    panel = station_day(facts).join(off, "fecha", "left_anti")
    return panel.join(daily_weather(weather), "fecha", "left").withColumn("log_total", F.log("total"))


RAIN = ("precip_sum", "rain_day")


def fit_weather(panel: DataFrame, rain: tuple[str, ...] = RAIN) -> list[OlsModel]:
    """A model for each measure of rain: station effects absorbed, weekday and month controls, errors clustered by station."""
    df, controls = calendar_controls(panel)
    specs = [("log_total", [measure, "temp_mean"]) for measure in rain]
    return ols_fits(df, specs, controls, absorb="codigo_estacion", cov="cluster", compress=False)


def weather_effect(panel: DataFrame) -> DataFrame:
    """Continuous and binary specification; intervals are b +- 1.96 se."""
    parts = []
    for rain, model in zip(RAIN, fit_weather(panel)):
        coefs = model.coefficients(critical=1.96)
        parts.append(coefs.withColumns({
            "modelo": F.lit(rain), "pct": percent("b"), "pct_lo": percent("lo"), "pct_hi": percent("hi"),
            "pct_10": percent(F.col("b") * 10), "pct_20": percent(F.col("b") * 20),
        }))
    return parts[0].unionByName(parts[1])


def effect_by_line(panel: DataFrame, line_lists: DataFrame, lines: DataFrame, min_rows: int = MIN_LINE_ROWS) -> DataFrame:
    """One HC3 regression per line of the stations it serves; a station counts for all its lines.

    Regressors depend on the day only, so the rows of a line merge into one cell per day.
    """
    df = panel.join(station_lines(line_lists), "codigo_estacion")
    df, controls = calendar_controls(df)
    model = ols_fit(df, "log_total", ["precip_sum", "temp_mean"], controls, by=["codigo_linea"], cov="hc3")
    coefs = model.coefficients(terms=["precip_sum"]).where(F.col("n") >= min_rows)
    table = named(coefs, lines, "codigo_linea", "nombre_linea", "Línea %s")
    return table.select(
        "codigo_linea", "nombre_linea", F.round("b", 6).alias("b"), F.round("se", 6).alias("se"),
        F.round(percent(F.col("b") * 10), 2).alias("pct_10mm"), F.round("p", 4).alias("p"), "n",
    )


def system_rain_scatter(panel: DataFrame) -> DataFrame:
    """Daily mean log demand with the rain, rain flag and temperature of the day."""
    return panel.groupBy("fecha").agg(
        F.avg("log_total").alias("log_mean"), F.max("precip_sum").alias("precip"),
        F.max("rain_day").alias("rain"), F.max("temp_mean").alias("temp"),
    )


def simple_trend(df: DataFrame, y: str, x: str) -> DataFrame:
    """Straight line through a scatter."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
