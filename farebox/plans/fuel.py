"""Fuel price and monthly demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.functions.numeric import stars
from farebox.operators.panels import first_difference
from farebox.operators.regression import OlsModel, ols_fit, ols_fits

REGRESSORS = ["log_precio", "trend", "n_festivos"]


def price_frame(monthly: DataFrame, fuel: DataFrame) -> DataFrame:
    return monthly.join(fuel, "mes")


OUTCOMES = ("log_val", "log_val_d")


def fit_levels(df: DataFrame, outcomes: tuple[str, ...] = OUTCOMES) -> list[OlsModel]:
    """Log demand on log price, trend and holidays, HC3, one matrix for all outcomes. Columns are centred before products."""
    return ols_fits(df, [(y, REGRESSORS) for y in outcomes], cov="hc3", compress=False)


def monthly_price_ols(df: DataFrame) -> DataFrame:
    """Monthly total and per-day demand; all three regressors."""
    parts = [m.coefficients().withColumn("modelo", F.lit(y)) for y, m in zip(OUTCOMES, fit_levels(df))]
    return parts[0].unionByName(parts[1]).withColumn("sig", stars("p", "ns"))


def vif_table(df: DataFrame) -> DataFrame:
    table = ols_fit(df, "log_val", REGRESSORS, compress=False).vif()
    return table.withColumn("severa", F.col("vif") > 10)


def price_trend_correlation(df: DataFrame) -> DataFrame:
    r = F.corr("log_precio", "trend")
    return df.agg(r.alias("r"), (r * r).alias("r2"))


def differences(df: DataFrame) -> DataFrame:
    return first_difference(df, "mes", ["log_val", "log_val_d", "log_precio", "n_festivos"])


def first_difference_ols(df: DataFrame) -> DataFrame:
    model = ols_fit(differences(df), "d_log_val_d", ["d_log_precio"], cov="hc3", compress=False)
    return model.coefficients().withColumn("sig", stars("p", "ns"))
