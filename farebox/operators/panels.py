"""Panels and summary tables over the fact table.

Every function is a keyed aggregation of sums, counts and means: Spark combines them before
the shuffle, so one station, line or day holding a third of all rows costs no more than
any other key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farebox.functions.calendar import with_hours
from farebox.operators.normal_equations import join_groups
from farebox.session import materialize


def sum_by(df: DataFrame, keys: list[str], value: str = "total", name: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(name or value))


def daily_total(df: DataFrame) -> DataFrame:
    """System total of each day."""
    return sum_by(df, ["fecha"])


def station_day(df: DataFrame, positive: bool = True) -> DataFrame:
    """Station x day totals; days without demand are dropped unless ``positive`` is off."""
    panel = sum_by(df, ["codigo_estacion", "fecha"])
    return panel.where("total > 0") if positive else panel


def station_hour(df: DataFrame, positive: bool = False) -> DataFrame:
    """Station x day x hour totals, from facts with clock texts or hours."""
    panel = sum_by(with_hours(df), ["codigo_estacion", "fecha", "hora_int"])
    return panel.where("total > 0") if positive else panel


def line_day(df: DataFrame) -> DataFrame:
    return sum_by(df, ["codigo_linea", "fecha"])


def monthly_rollup(daily: DataFrame, holidays: DataFrame) -> DataFrame:
    """Monthly demand, days with data, holidays, demand per day, logs and a 1..n trend.

    ``holidays`` has a ``date`` column that may repeat dates.
    """
    days = holidays.select(F.col("date").alias("fecha")).distinct().withColumn("festivo", F.lit(1))
    monthly = (
        daily.join(days, "fecha", "left")
        .groupBy(F.trunc("fecha", "month").alias("mes"))
        .agg(
            F.sum("total").alias("val_mes"),
            F.count("*").alias("n_dias"),
            F.sum(F.coalesce("festivo", F.lit(0))).alias("n_festivos"),
        )
    )
    # One row per month of the data: the unpartitioned window below sorts a few hundred rows.
    return monthly.withColumns({
        "val_dia": F.col("val_mes") / F.col("n_dias"),
        "log_val": F.log("val_mes"),
        "log_val_d": F.log(F.col("val_mes") / F.col("n_dias")),
        "trend": F.row_number().over(W.orderBy("mes")),
    })


def daily_weather(weather: DataFrame, rain_mm: float = 5.0) -> DataFrame:
    """Sum and maximum of precipitation, mean temperature and a rain flag per day."""
    return (
        weather.groupBy(F.to_date("time").alias("fecha"))
        .agg(
            F.sum("precipitation").alias("precip_sum"),
            F.max("precipitation").alias("precip_max"),
            F.avg("temperature_2m").alias("temp_mean"),
        )
        .withColumn("rain_day", (F.col("precip_sum") > rain_mm).cast("int"))
    )


def mean_by(df: DataFrame, keys: list[str], value: str, name: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(name or value))


# Different values of a key that one task ranks, and the ranges a key's values are cut into to get there.
RANKED, RANGES = 4096, 256


def median_by(df: DataFrame, key: str, value: str, name: str, ranked: int = RANKED) -> DataFrame:
    """Exact medians of finite values, the mean of the two middle ones for an even number; null where there are none.

    Values are counted first. Each key's two middle ranks are then narrowed down: the values between
    a lower and an upper end are counted in ``RANGES`` ranges, and the range that holds the rank
    becomes the next one, until ``ranked`` different values are left. So no task holds a key's
    values, however many there are. The smallest and largest value fall into different ranges, so
    every round narrows.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"))
    counts = materialize(rows.where("_v IS NOT NULL").groupBy("_k", "_v").agg(F.count("*").alias("_n")))
    ends = counts.groupBy("_k").agg(
        F.sum("_n").alias("_all"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_values")
    )
    middle = F.explode(F.array(F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2))).alias("_rank")
    wanted = materialize(ends.select("_k", middle, "_low", "_high", "_values").distinct())
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    while not wanted.where(F.col("_values") > ranked).isEmpty():
        part = F.floor((F.col("_v") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * RANGES)
        cut = join_groups(counts, wanted, ["_k"]).where(inside)
        cut = cut.withColumn("_part", F.coalesce(F.least(part, F.lit(RANGES - 1)), F.lit(0))).withColumnRenamed("_low", "_from")
        sums = cut.groupBy("_k", "_rank", "_from", "_part").agg(
            F.sum("_n").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_values")
        )
        upto = F.sum("_n").over(W.partitionBy("_k", "_rank", "_from").orderBy("_part"))
        # Ranks count from the lower end; at most RANGES rows for each.
        found = sums.withColumn("_upto", upto).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
        left = F.col("_rank") - (F.col("_upto") - F.col("_n"))
        wanted = materialize(found.select("_k", left.alias("_rank"), "_low", "_high", "_values"))
    last = join_groups(counts, wanted, ["_k"]).where(inside)
    upto = F.sum("_n").over(W.partitionBy("_k", "_rank", "_low").orderBy("_v"))
    last = last.withColumn("_upto", upto).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
    medians = last.groupBy("_k").agg(F.avg("_v").alias("_m"))
    found = join_groups(rows.select("_k").distinct(), medians, ["_k"], "left")
    return found.select(F.col("_k").alias(key), F.col("_m").alias(name))


def profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample standard deviation, count and standard error by key."""
    return (
        df.groupBy(*keys)
        .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))
        .withColumn("se", F.col("std") / F.sqrt("count"))
    )


def moments(df: DataFrame, value: str) -> DataFrame:
    """Global mean, extremes, range and population variance in one row."""
    return df.agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        (F.max(value) - F.min(value)).alias("range"), F.var_pop(value).alias("var"),
    )


def top_per_group(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """The key with the largest value in each group, smallest key on ties.

    A struct maximum combines before the shuffle, unlike ranking a whole group by window.
    """
    best = F.min(F.struct((-F.col(value)).alias("neg"), F.col(key).alias("key")))
    return df.groupBy(group).agg(best.alias("b")).select(
        group, F.col("b.key").alias(key), (-F.col("b.neg")).alias(value)
    )


def top_overall(df: DataFrame, key: str, value: str = "total") -> DataFrame:
    """The single largest row, smallest key on ties."""
    return df.orderBy(F.desc(value), F.asc(key)).limit(1)


def dense_hours(df: DataFrame, keys: list[str], value: str, hour: str = "hora_int") -> DataFrame:
    """Every key with all 24 hours, absent hours filled with zero."""
    grid = df.select(*keys).distinct().withColumn(hour, F.explode(F.sequence(F.lit(0), F.lit(23))))
    return grid.join(df, [*keys, hour], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def centre_by_group(df: DataFrame, keys: list[str], value: str, out: str, where=None) -> DataFrame:
    """Subtract the group mean, taken over all rows or over rows matching ``where``.

    Means are aggregated first and joined back: no task ever holds a whole group.
    """
    base = F.avg(F.when(where, F.col(value)) if where is not None else F.col(value))
    means = df.groupBy(*keys).agg(base.alias("_m"))
    return df.join(means, keys, "left").withColumn(out, F.col(value) - F.col("_m")).drop("_m")


def first_difference(df: DataFrame, order: str, columns: list[str], series: list[str] | None = None) -> DataFrame:
    """Add ``d_<column>`` against the previous row of each series; the first row is dropped.

    ``series`` names the columns that identify one; without it all rows are one series. Rows are dealt
    by ranges of (series, order), so one long series is in many tasks; the last row of a range is
    carried to the next, which is one row for each range.
    """
    by = [*(series or []), order]
    placed = df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id())
    placed = materialize(placed)
    row = F.struct(*by, *columns)
    inside = W.partitionBy("_range").orderBy(*by)
    last = placed.groupBy("_range").agg(F.max_by(row, F.struct(*by)).alias("_last"))
    # A row for each range: their number is that of tasks, not of rows.
    carried = last.withColumn("_border", F.lag("_last").over(W.orderBy("_range"))).select("_range", "_border")
    out = placed.withColumn("_before", F.lag(row).over(inside)).join(F.broadcast(carried), "_range")
    before = F.coalesce("_before", "_border")
    same = F.lit(True)
    for c in series or []:
        same = same & before[c].eqNullSafe(F.col(c))
    out = out.withColumns({f"d_{c}": F.when(same, F.col(c) - before[c]) for c in columns})
    return out.drop("_range", "_before", "_border").na.drop(subset=[f"d_{c}" for c in columns])


def pivot_wide(df: DataFrame, rows: str, column: str, value: str, levels: list) -> DataFrame:
    """Long to wide with known levels, so no extra pass looks for them."""
    return df.groupBy(rows).pivot(column, levels).agg(F.first(value))
