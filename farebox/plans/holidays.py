"""Holiday event study on the daily system total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.functions.calendar import holiday_type
from farebox.functions.numeric import one_hot, percent, stars
from farebox.operators.events import WINDOW, event_time_join
from farebox.operators.panels import median_by
from farebox.operators.regression import OlsModel, ols_fit

BASELINE = -1
STUDIED = [k for k in range(-WINDOW, WINDOW + 1) if k != BASELINE]
DOW_LEVELS, MONTH_LEVELS = range(7), range(1, 13)


def calendar_controls(df: DataFrame, day: str = "fecha") -> tuple[DataFrame, list[str]]:
    """Weekday and month indicators; Monday and January are the reference levels."""
    df = df.withColumns({"dow": F.weekday(day), "month": F.month(day)})
    hot = {**one_hot("dow", DOW_LEVELS, "dow"), **one_hot("month", MONTH_LEVELS, "month")}
    return df.withColumns(hot), list(hot)


def daily_frame(daily: DataFrame, holidays: DataFrame) -> tuple[DataFrame, list[str]]:
    df = event_time_join(daily, holidays).withColumn("log_total", F.log("total"))
    return calendar_controls(df)


def term(k: int, group: str = "") -> str:
    """The regressor of an offset is named by the signed offset itself, after its group."""
    return f"{group}{k:+d}"


def indicators(df: DataFrame, offsets: str = "offsets", group: str = "") -> tuple[DataFrame, list[str]]:
    """An indicator for every studied offset among a day's ``offsets``; the baseline has none."""
    has = {term(k, group): F.array_contains(offsets, k).cast("int") for k in STUDIED}
    return df.withColumns(has), list(has)


def fit_event_study(daily: DataFrame, holidays: DataFrame, cov: str = "hc3") -> OlsModel:
    df, controls = daily_frame(daily, holidays)
    df, terms = indicators(df)
    return ols_fit(df, "log_total", terms, controls, cov=cov, compress=False)


def _by_offset(coefs: DataFrame, group: str = "") -> DataFrame:
    """Coefficients with their offset k, read off the terms, the omitted baseline as a zero row, per cent and stars."""
    own = coefs.where(F.col("term").startswith(group))
    rows = own.select(F.substring("term", len(group) + 1, 9).cast("int").alias("k"), "b", "lo", "hi", "p")
    zero = F.lit(0.0)
    base = coefs.sparkSession.range(1).select(
        F.lit(BASELINE).alias("k"), zero.alias("b"), zero.alias("lo"), zero.alias("hi"), F.lit(None).cast("double").alias("p")
    )
    return rows.unionByName(base).select(
        "k", "b", "lo", "hi", "p", percent("b").alias("pct"), F.coalesce(stars("p"), F.lit("")).alias("sig")
    )


def event_study_daily(daily: DataFrame, holidays: DataFrame) -> DataFrame:
    """Effect of each offset around a holiday against the day before it (HC3)."""
    return _by_offset(fit_event_study(daily, holidays).coefficients())


def pretrend_test(daily: DataFrame, holidays: DataFrame) -> DataFrame:
    """Joint F test that the offsets before the baseline are zero, from classical fits."""
    before = [term(k) for k in STUDIED if k < BASELINE]
    return fit_event_study(daily, holidays, cov="nonrobust").nested_f(before)


SUBGROUPS = {"lun_": "lunes_puente", "mid_": "mitad_semana"}


def fit_subgroups(daily: DataFrame, holidays: DataFrame) -> OlsModel:
    """Joint model with separate offsets for bridge Mondays and midweek holidays."""
    df = daily.withColumn("log_total", F.log("total"))
    typed = holidays.select("date").distinct().withColumn("tipo", holiday_type("date"))
    terms = []
    for group, kind in SUBGROUPS.items():
        df = event_time_join(df, typed.where(F.col("tipo") == kind), out=f"{group}offsets", overlap=None)
        df, own = indicators(df, f"{group}offsets", group)
        terms += own
    df, controls = calendar_controls(df)
    return ols_fit(df, "log_total", terms, controls, cov="hc3", compress=False)


def event_study_subgroups(daily: DataFrame, holidays: DataFrame) -> DataFrame:
    coefs = fit_subgroups(daily, holidays).coefficients()
    parts = [
        _by_offset(coefs, group).withColumn("tipo", F.lit(kind)) for group, kind in SUBGROUPS.items()
    ]
    return parts[0].unionByName(parts[1])


def subgroup_equality(daily: DataFrame, holidays: DataFrame, offsets=(0, 1, 2)) -> DataFrame:
    """F test, per offset, that both types have the same effect."""
    tests = {f"k={k:+d}": {term(k, "lun_"): 1.0, term(k, "mid_"): -1.0} for k in offsets}
    return fit_subgroups(daily, holidays).wald(tests)


def individual_effects(daily: DataFrame, holidays: DataFrame) -> DataFrame:
    """Each holiday against the median of clean days of its weekday; repeated dates stay repeated."""
    days = event_time_join(daily, holidays).withColumn("dow", F.weekday("fecha"))
    base = median_by(days.where("n_overlap = 0"), "dow", "total", "mediana")
    return (
        holidays.select(F.col("date").alias("fecha"), "local_name")
        .join(daily.select("fecha", "total"), "fecha")
        .withColumn("dow", F.weekday("fecha"))
        .join(base, "dow", "left")
        .select(
            "fecha", "local_name", F.date_format("fecha", "EEE").alias("dia"), holiday_type("fecha").alias("tipo"),
            "total", F.round((F.col("total") / F.col("mediana") - 1) * 100, 1).alias("efecto_pct"),
        )
    )


def effects_by_type(individual: DataFrame) -> DataFrame:
    return individual.groupBy("tipo").agg(F.count("*").alias("n"), F.avg("efecto_pct").alias("efecto_medio"))
