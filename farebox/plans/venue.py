"""Events at a venue: hour-by-hour effects at nearby stations.

``panel`` is station x day x hour (codigo_estacion, fecha, hora_int, total); ``calendar`` has
(fecha, nombre, tipo) with tipo ``concierto`` or ``festival``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.functions.calendar import day_kind, day_name
from farebox.functions.numeric import distance_bin, log_floor_one, percent, stars
from farebox.operators.events import day_tags, event_panel, nearest_pooled, nearest_same_weekday
from farebox.operators.panels import dense_hours, profile, sum_by
from farebox.operators.regression import OlsModel, ols_fit
from farebox.session import attach_row

DISTANCE_EDGES = [0, 500, 1500, 3000]
SPILLOVER_HOURS = (20, 23)
COMPARE_HOURS = (18, 23)
BIG_NIGHT_RATIO = 4.0


def concerts(calendar: DataFrame) -> DataFrame:
    return calendar.where("tipo = 'concierto'")


def festival_days(calendar: DataFrame, holidays: DataFrame) -> DataFrame:
    """Festival days that are not public holidays."""
    return calendar.where("tipo = 'festival'").join(holidays.select(F.col("date").alias("fecha")), "fecha", "left_anti")


def barred_days(calendar: DataFrame, holidays: DataFrame) -> DataFrame:
    """Days that can never be controls: every catalogued event and every public holiday."""
    return calendar.select("fecha").union(holidays.select(F.col("date").alias("fecha"))).distinct()


def concert_controls(calendar: DataFrame, holidays: DataFrame, days: DataFrame, n: int = 5) -> DataFrame:
    return nearest_same_weekday(concerts(calendar), days, n, barred_days(calendar, holidays))


def festival_controls(calendar: DataFrame, holidays: DataFrame, days: DataFrame, n: int = 4) -> DataFrame:
    return nearest_pooled(festival_days(calendar, holidays), days, n, barred_days(calendar, holidays))


def big_night_controls(nights: DataFrame, calendar: DataFrame, holidays: DataFrame, days: DataFrame, n: int = 5) -> DataFrame:
    """Controls of detected nights; other detected nights may serve, the night itself may not."""
    return nearest_same_weekday(nights, days, n, barred_days(calendar, holidays), skip_self=True)


def study_panel(panel: DataFrame, events: DataFrame, controls: DataFrame) -> DataFrame:
    """Event and control days of the panel with the event indicator and log demand."""
    return event_panel(panel, day_tags(events, controls)).withColumn("log_total", log_floor_one("total"))


def fit_hourly(panel: DataFrame, cov: str = "hc3", by=("hora_int",)) -> OlsModel:
    """One regression per hour: event indicator with station effects absorbed."""
    return ols_fit(panel, "log_total", ["event_d"], absorb="codigo_estacion", by=list(by), cov=cov)


def thick_enough(min_rows: int, min_treated: int = 0):
    """Both treatment levels, enough rows and enough treated rows, read off the fitted sums."""
    treated = F.round(F.col("mean") * F.col("n"))
    return (F.col("n") >= min_rows) & (treated >= max(min_treated, 1)) & (treated < F.col("n"))


def event_study_hourly(
    panel: DataFrame, cov: str = "hc3", min_rows: int = 6, min_treated: int = 0, by: tuple = ("hora_int",),
    dense: bool = True,
) -> DataFrame:
    """Effect per hour with interval, p value and per cent.

    Hours with fewer than ``min_rows`` rows, one treatment level or fewer than
    ``min_treated`` treated rows give a null row (or none, with ``dense`` off).
    """
    by = list(by)
    coefs = fit_hourly(panel, cov, by).coefficients().where(thick_enough(min_rows, min_treated)).select(
        *by, "b", "se", "lo", "hi", "p", percent("b").alias("pct"), percent("lo").alias("pct_lo"),
        percent("hi").alias("pct_hi"), stars("p").alias("sig"), "n",
    )
    if not dense or by != ["hora_int"]:
        return coefs
    hours = panel.sparkSession.range(24).select(F.col("id").cast("int").alias("hora_int"))
    return hours.join(coefs, "hora_int", "left")


def peak_effect(effects: DataFrame) -> DataFrame:
    """Hour of the largest per cent effect."""
    return effects.agg(F.max_by("hora_int", "pct").alias("hora_int"), F.max("pct").alias("pct"))


def tags_by_day_kind(tags: DataFrame) -> DataFrame:
    """Tags per kind of day: events of that kind, and controls of the same weekdays."""
    events = tags.where("event_d = 1").withColumn("tipo_dia", day_kind("fecha"))
    kinds = events.select("tipo_dia", F.weekday("fecha").alias("_dow")).distinct()
    controls = tags.where("event_d = 0").withColumn("_dow", F.weekday("fecha")).join(kinds, "_dow")
    return events.unionByName(controls.select(*events.columns))


def by_day_kind(panel: DataFrame, events: DataFrame, controls: DataFrame) -> DataFrame:
    """Event study for weekend and working-day events, controls of the same weekdays, 4-row rule."""
    both = event_panel(panel, tags_by_day_kind(day_tags(events, controls)))
    both = both.withColumn("log_total", log_floor_one("total"))
    return event_study_hourly(both, min_rows=4, by=("tipo_dia", "hora_int"), dense=False)


def spillover_by_distance(panel: DataFrame, distances: DataFrame) -> DataFrame:
    """Event study per distance band for the late hours, with the number of stations."""
    # One distance per station. Grouping also keeps the optimizer from copying the projection
    # series into every later use of the band.
    near = distances.groupBy("codigo_estacion").agg(F.min("dist_m").alias("dist_m"))
    near = near.select("codigo_estacion", distance_bin("dist_m", DISTANCE_EDGES).alias("dist_bin"))
    df = panel.join(near, "codigo_estacion").where("dist_bin IS NOT NULL")
    df = df.where(F.col("hora_int").between(*SPILLOVER_HOURS))
    by = ["dist_bin", "hora_int"]
    stations = df.select(*by, "codigo_estacion").distinct().groupBy(*by).agg(F.count("*").alias("n_est"))
    return event_study_hourly(df, by=tuple(by), dense=False).join(stations, by)


def compare_event_types(concert_panel: DataFrame, festival_panel: DataFrame) -> DataFrame:
    """Concerts against festival days per late hour: both effects, difference, F test."""
    both = (
        concert_panel.withColumn("fdv_flag", F.lit(0))
        .unionByName(festival_panel.withColumn("fdv_flag", F.lit(1)))
        .where(F.col("hora_int").between(*COMPARE_HOURS))
        .withColumn("event_x_fdv", F.col("event_d") * F.col("fdv_flag"))
    )
    model = ols_fit(
        both, "log_total", ["event_d", "fdv_flag", "event_x_fdv"], absorb="codigo_estacion", by=["hora_int"], cov="hc3"
    )
    coefs = model.coefficients()
    pick = lambda t: F.max(F.when(F.col("term") == t, F.col("b")))
    event = F.col("term") == "event_d"
    effects = coefs.groupBy("hora_int").agg(
        pick("event_d").alias("b_conc"), pick("event_x_fdv").alias("b_int"),
        F.max("n").alias("n"), F.max(F.when(event, F.col("mean"))).alias("mean"),
    ).where(F.col("b_conc").isNotNull() & F.col("b_int").isNotNull() & thick_enough(8))
    tests = model.wald({"igual": {"event_x_fdv": 1.0}}).select("hora_int", "f", "p")
    out = effects.join(tests, "hora_int")
    b_fdv = F.col("b_conc") + F.col("b_int")
    return out.select(
        "hora_int", "b_conc", percent("b_conc").alias("pct_conc"), b_fdv.alias("b_fdv"), percent(b_fdv).alias("pct_fdv"),
        (percent(b_fdv) - percent("b_conc")).alias("dif_pp"), "f", "p", stars("p", "(ns)").alias("sig"),
    )


def combined(panel: DataFrame) -> DataFrame:
    """Total of all stations per day and hour."""
    return sum_by(panel, ["fecha", "hora_int", "event_d"])


def hour_profile(panel: DataFrame) -> DataFrame:
    """Mean, sd, count, se and 95 % band of the combined total by hour, events and controls."""
    prof = profile(combined(panel), ["hora_int", "event_d"], "total")
    return prof.withColumns({"lo": F.col("mean") - 1.96 * F.col("se"), "hi": F.col("mean") + 1.96 * F.col("se")})


def event_excess(prof: DataFrame) -> DataFrame:
    """Mean on event days minus mean on control days, hours present in both."""
    pick = lambda v: F.max(F.when(F.col("event_d") == v, F.col("mean")))
    return prof.groupBy("hora_int").agg(pick(1).alias("evento"), pick(0).alias("control")).na.drop().withColumn(
        "exceso", F.col("evento") - F.col("control")
    )


def control_by_weekday(panel: DataFrame) -> DataFrame:
    """Control mean per weekday and hour of the combined total."""
    c = combined(panel.where("event_d = 0")).withColumn("dow", F.weekday("fecha"))
    return c.groupBy("dow", "hora_int").agg(F.avg("total").alias("control"))


def event_profiles(panel: DataFrame, events: DataFrame) -> DataFrame:
    """Every event day on a full 24-hour grid beside its weekday's control mean."""
    ev = dense_hours(combined(panel.where("event_d = 1")).select("fecha", "hora_int", "total"), ["fecha"], "total")
    ev = ev.withColumn("dow", F.weekday("fecha")).join(control_by_weekday(panel), ["dow", "hora_int"], "left")
    return ev.join(events.select("fecha", "nombre"), "fecha").select(
        "fecha", "nombre", "hora_int", F.col("total").alias("evento"), F.coalesce("control", F.lit(0.0)).alias("control")
    )


def event_ratio_at_hour(panel: DataFrame, events: DataFrame, hour: int = 23) -> DataFrame:
    """Demand of each event at one hour over its weekday's control mean; no control, no row."""
    at = event_profiles(panel, events).where((F.col("hora_int") == hour) & (F.col("control") > 0))
    return at.select("fecha", "nombre", "evento", "control", (F.col("evento") / F.col("control")).alias("ratio"))


def festival_ratios(panel: DataFrame, stations: DataFrame) -> DataFrame:
    """Per festival day the ratios at 20 h and 23 h.

    The control is the mean per station row of the weekday and hour times the number of
    stations in ``stations``.
    """
    dow = F.weekday("fecha")
    n = stations.agg(F.count_distinct("codigo_estacion").alias("_n"))
    per_row = panel.where("event_d = 0").groupBy(dow.alias("dow")).agg(
        *[F.avg(F.when(F.col("hora_int") == h, F.col("total"))).alias(f"_c{h}") for h in (20, 23)]
    )
    days = panel.where("event_d = 1").groupBy("fecha").agg(
        *[F.coalesce(F.sum(F.when(F.col("hora_int") == h, F.col("total"))), F.lit(0)).alias(f"v{h}") for h in (20, 23)]
    )
    out = attach_row(days.withColumn("dow", dow).join(per_row, "dow", "left"), n)
    for h in (20, 23):
        c = F.col(f"_c{h}") * F.col("_n")
        out = out.withColumns({f"c{h}": c, f"r{h}": F.when(c > 0, F.col(f"v{h}") / c)})
    return out.select("fecha", day_name("fecha").alias("dia"), day_kind("fecha").alias("tipo"),
                      "v20", "c20", "r20", "v23", "c23", "r23")


def festival_ratio_means(ratios: DataFrame) -> DataFrame:
    return ratios.groupBy("tipo").agg(F.avg("r20").alias("r20"), F.avg("r23").alias("r23"))


def night_ratios(panel: DataFrame, calendar: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Every day's demand at 18, 20 and 23 h against the mean of uncatalogued days.

    ``days`` lists all days of the table where ``panel`` holds only nearby stations; a day
    without any of their rows then counts as zero.
    """
    at = lambda h: F.coalesce(F.sum(F.when(F.col("hora_int") == h, F.col("total"))), F.lit(0)).alias(f"h{h}")
    if days is not None:
        panel = days.select("fecha").distinct().join(panel, "fecha", "left")
    nights = panel.groupBy("fecha").agg(at(18), at(20), at(23))
    kinds = calendar.groupBy("fecha").agg(
        F.max(F.when(F.col("tipo") == "concierto", F.col("nombre"))).alias("_conc"), F.max("tipo").alias("_any")
    )
    tagged = nights.join(kinds, "fecha", "left").withColumns({
        "categoria": F.when(F.col("_conc").isNotNull(), "concierto").when(F.col("_any").isNotNull(), "FdV").otherwise("normal"),
        "etiqueta": F.when(F.col("_any") == "festival", "FdV").otherwise(F.col("_conc")),
    }).drop("_conc", "_any")
    normal = F.col("categoria") == "normal"
    means = tagged.agg(
        F.avg(F.when(normal, F.col("h23"))).alias("_m23"), F.avg(F.when(normal, F.col("h18"))).alias("_m18")
    )
    return attach_row(tagged, means).select(
        "fecha", "h18", "h20", "h23", (F.col("h23") / F.nullif("_m23", F.lit(0.0))).alias("r23"),
        (F.col("h18") / F.nullif("_m18", F.lit(0.0))).alias("r18"), "etiqueta", "categoria",
    )


def detect_big_events(ratios: DataFrame, threshold: float = BIG_NIGHT_RATIO) -> DataFrame:
    """Uncatalogued days whose 23 h demand exceeds ``threshold`` times the normal mean."""
    big = ratios.where((F.col("r23") > threshold) & (F.col("categoria") == "normal"))
    return big.select("fecha", day_name("fecha").alias("dia"), "r23", "h23").orderBy(F.desc("r23"), "fecha")


def concerts_vs_big_nights(concert_panel: DataFrame, big_panel: DataFrame) -> DataFrame:
    """Classical-error event study of both groups, at least three treated rows per hour."""
    both = concert_panel.select("codigo_estacion", "fecha", "hora_int", "log_total", "event_d").withColumn(
        "grupo", F.lit("conciertos")
    ).unionByName(
        big_panel.select("codigo_estacion", "fecha", "hora_int", "log_total", "event_d").withColumn(
            "grupo", F.lit("grandes"))
    )
    return event_study_hourly(both, cov="nonrobust", min_rows=0, min_treated=3, by=("grupo", "hora_int"), dense=False)
