"""Open-street Sundays: difference in differences by distance to the routes.

``near`` is a table (codigo_estacion, cerca) with cerca in {0, 1}.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.functions.calendar import in_hours, week_number
from farebox.functions.distributions import t_two_sided
from farebox.functions.numeric import one_hot, percent
from farebox.operators.panels import centre_by_group, mean_by, pivot_wide, station_day, station_hour
from farebox.operators.regression import OlsModel, ols_fit
from farebox.plans.holidays import calendar_controls

SATURDAY, SUNDAY = 5, 6
DAY_HOURS, OPEN_HOURS, CLOSED_FROM = (6, 20), (7, 13), 14


def tag(panel: DataFrame, near: DataFrame) -> DataFrame:
    """Add ``cerca`` (stations without a tag count as far) and log demand."""
    return panel.join(near.select("codigo_estacion", "cerca"), "codigo_estacion", "left").withColumns({
        "cerca": F.coalesce("cerca", F.lit(0)), "log_total": F.log("total"),
    })


def daily_panel(facts: DataFrame, near: DataFrame) -> DataFrame:
    return tag(station_day(facts), near).withColumn("is_sunday", (F.weekday("fecha") == SUNDAY).cast("int"))


def hourly_panel(facts: DataFrame, near: DataFrame, weekday: int) -> DataFrame:
    """Positive station-hours of one weekday."""
    return tag(station_hour(facts.where(F.weekday("fecha") == weekday), positive=True), near)


def fit_two_way(panel: DataFrame, with_controls: bool = True) -> OlsModel:
    """Sunday x near, station effects, weekday and month controls, clustered by station."""
    df = panel.withColumn("cerca_x_sunday", F.col("cerca") * F.col("is_sunday"))
    df, controls = calendar_controls(df)
    return ols_fit(
        df, "log_total", ["cerca_x_sunday"], controls if with_controls else [], absorb="codigo_estacion", cov="cluster"
    )


def fit_window(hourly: DataFrame, with_controls: bool = True) -> OlsModel:
    """Opening hours x near within one weekday, station effects, hour controls, clustered."""
    lo, hi = DAY_HOURS
    hot = one_hot("hora_int", range(lo, hi + 1), "h")
    df = hourly.where(F.col("hora_int").between(lo, hi)).withColumns(hot)
    df = df.withColumn("cerca_x_ventana", F.col("cerca") * in_hours("hora_int", *OPEN_HOURS))
    return ols_fit(
        df, "log_total", ["cerca_x_ventana"], list(hot) if with_controls else [], absorb="codigo_estacion",
        cov="cluster",
    )


def report(model: OlsModel, label: str) -> DataFrame:
    """Coefficient with b +- 1.96 se and its per cent effect."""
    return model.coefficients(critical=1.96).select(
        F.lit(label).alias("spec"), "term", "b", "se", "p", "lo", "hi", percent("b").alias("pct"), "n", "r2"
    )


def did_two_way(facts: DataFrame, near: DataFrame, with_controls: bool = True) -> DataFrame:
    return report(fit_two_way(daily_panel(facts, near), with_controls), "domingo x cerca")


def did_window(facts: DataFrame, near: DataFrame, with_controls: bool = True) -> DataFrame:
    return report(fit_window(hourly_panel(facts, near, SUNDAY), with_controls), "ventana domingos")


def did_placebo(facts: DataFrame, near: DataFrame, with_controls: bool = True) -> DataFrame:
    """The window model on Saturdays, when streets are not opened."""
    return report(fit_window(hourly_panel(facts, near, SATURDAY), with_controls), "placebo sábados")


def dow_means(panel: DataFrame) -> DataFrame:
    return mean_by(panel.withColumn("dow", F.weekday("fecha")), ["cerca", "dow"], "log_total", "log_mean")


def sunday_weekday_ratio(panel: DataFrame) -> DataFrame:
    """Mean Sunday demand over mean demand of all other days, by group."""
    sunday = F.col("is_sunday") == 1
    means = panel.groupBy("cerca").agg(
        F.avg(F.when(~sunday, F.col("total"))).alias("weekday"), F.avg(F.when(sunday, F.col("total"))).alias("sunday")
    )
    return means.withColumn("ratio", F.col("sunday") / F.col("weekday"))


def ratio_difference(ratios: DataFrame) -> DataFrame:
    near, far = (F.max(F.when(F.col("cerca") == v, F.col("ratio"))) for v in (1, 0))
    return ratios.agg(near.alias("ratio_cerca"), far.alias("ratio_lejos"), (near - far).alias("diferencia"))


def weekly_gaps(panel: DataFrame) -> DataFrame:
    """Weekly mean log demand near minus far, Sundays and Mon-Fri, weeks with both groups only.

    Weeks are numbered through time, so several years do not fold onto each other.
    """
    dow = F.weekday("fecha")
    serie = F.when(dow == SUNDAY, "domingo").when(dow <= 4, "laboral")
    df = panel.withColumns({"serie": serie, "semana": week_number("fecha")}).where("serie IS NOT NULL")
    means = df.groupBy("serie", "semana").agg(
        F.avg(F.when(F.col("cerca") == 1, F.col("log_total"))).alias("tratadas"),
        F.avg(F.when(F.col("cerca") == 0, F.col("log_total"))).alias("control"),
    )
    return means.na.drop().withColumn("gap", F.col("tratadas") - F.col("control"))


def parallel_trends(panel: DataFrame) -> DataFrame:
    """Correlation of the two Sunday series, trend of their gap with its p value, naive DiD."""
    sunday, work = F.col("serie") == "domingo", F.col("serie") == "laboral"
    only = lambda c: F.when(sunday, F.col(c))
    stats = weekly_gaps(panel).agg(
        F.sum(sunday.cast("long")).alias("n_semanas"),
        F.corr(only("tratadas"), only("control")).alias("rho"),
        F.regr_slope(only("gap"), only("semana")).alias("slope"),
        F.corr(only("gap"), only("semana")).alias("_r"),
        (F.avg(only("gap")) - F.avg(F.when(work, F.col("gap")))).alias("did_naive"),
    )
    df = F.col("n_semanas") - 2
    stats = stats.withColumn("t", F.col("_r") * F.sqrt(df / (1 - F.col("_r") * F.col("_r"))))

    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(a, b - 2) if pd.notna(a) else None for a, b in zip(t, n)], dtype="float64")

    return stats.withColumns({"p": p_value("t", "n_semanas"), "did_pct": percent("did_naive")}).drop("_r")


def hourly_gap_profile(hourly: DataFrame) -> DataFrame:
    """Mean log demand by hour and group, minus the group's mean after closing, near minus far."""
    means = mean_by(hourly, ["cerca", "hora_int"], "log_total")
    norm = centre_by_group(means, ["cerca"], "log_total", "log_norm", where=F.col("hora_int") >= CLOSED_FROM)
    wide = pivot_wide(norm, "hora_int", "cerca", "log_norm", [0, 1])
    return wide.select(
        "hora_int", F.col("0").alias("lejos"), F.col("1").alias("cerca"), (F.col("1") - F.col("0")).alias("diff")
    ).na.drop()
