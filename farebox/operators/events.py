"""Event calendars: event time around holidays and matched control days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farebox.session import materialize

WINDOW = 5


def event_time_join(
    days: DataFrame, calendar: DataFrame, lo: int = -WINDOW, hi: int = WINDOW, key: str = "fecha",
    date: str = "date", out: str = "offsets", overlap: str | None = "n_overlap",
) -> DataFrame:
    """Add the sorted offsets ``k`` of a day (it lies k days after some event), and how many there are.

    Each event is expanded to the days it touches and joined by equality, so several events
    may mark one day and the day table is neither multiplied nor compared by range. A day has
    at most hi - lo + 1 offsets, whatever the calendar holds.
    """
    touched = (
        calendar.select(F.col(date).cast("date").alias("_d")).distinct()
        .select(F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("_k"), "_d")
        .groupBy(F.date_add("_d", F.col("_k")).alias(key))
        .agg(F.sort_array(F.collect_set("_k")).alias(out))
    )
    joined = days.join(touched, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<int>")))
    return joined.withColumn(overlap, F.size(out)) if overlap else joined


def nearest_same_weekday(events: DataFrame, days: DataFrame, n: int, excluded: DataFrame | None = None,
                         skip_self: bool = False) -> DataFrame:
    """The n nearest days of the same weekday for every event (earlier day first on ties).

    ``events``, ``days`` and ``excluded`` each have a ``fecha``; events and excluded days are
    never controls (with ``skip_self`` only the event itself is barred beside ``excluded``).

    Eligible days are numbered within their weekday. The n nearest ones are among the n before
    and the n after the event's own position, so an equality join on (weekday, position)
    finds them without comparing events with all days.
    """
    ev = events.select("fecha").distinct()
    barred = excluded.select("fecha").distinct() if excluded is not None else None
    eligible = days.select("fecha").distinct()
    if not skip_self:
        eligible = eligible.join(ev, "fecha", "left_anti")
    if barred is not None:
        eligible = eligible.join(barred, "fecha", "left_anti")
    # One row per calendar day and event day: a few thousand rows in seven groups.
    both = (
        eligible.select("fecha", F.lit(1).alias("_c"), F.lit(0).alias("_e"))
        .unionByName(ev.select("fecha", F.lit(0).alias("_c"), F.lit(1).alias("_e")))
        .groupBy("fecha").agg(F.max("_c").alias("_c"), F.max("_e").alias("_e"))
        .withColumn("dow", F.weekday("fecha"))
    )
    pos = F.sum("_c").over(W.partitionBy("dow").orderBy("fecha").rowsBetween(W.unboundedPreceding, 0))
    placed = both.withColumn("_pos", pos)
    reach = n + 1
    wanted = placed.where("_e = 1").select(
        F.col("fecha").alias("evento"), "dow",
        F.explode(F.sequence(F.col("_pos") - reach, F.col("_pos") + reach)).alias("_pos"),
    )
    cands = placed.where("_c = 1").select(F.col("fecha").alias("control"), "dow", "_pos")
    pairs = wanted.join(cands, ["dow", "_pos"]).where("evento <> control").withColumn(
        "dist", F.abs(F.datediff("control", "evento"))
    )
    w = W.partitionBy("evento").orderBy("dist", "control")
    return (
        pairs.withColumn("orden", F.row_number().over(w)).where(F.col("orden") <= n)
        .select("evento", "control", "dow", "dist", "orden")
    )


def nearest_pooled(events: DataFrame, days: DataFrame, n: int, excluded: DataFrame | None = None) -> DataFrame:
    """Per weekday the n days nearest to any event of that weekday.

    A day among the n nearest of the pool is among the n nearest of the event closest to it,
    so ranking the per-event lists is exact.
    """
    each = nearest_same_weekday(events, days, n, excluded)
    best = each.groupBy("dow", "control").agg(F.min("dist").alias("dist"))
    w = W.partitionBy("dow").orderBy("dist", "control")
    return best.withColumn("orden", F.row_number().over(w)).where(F.col("orden") <= n)


def day_tags(events: DataFrame, controls: DataFrame) -> DataFrame:
    """Event days (``event_d`` = 1) and control days (``event_d`` = 0); a day may be both."""
    return (
        events.select("fecha", F.lit(1).alias("event_d")).distinct()
        .unionByName(controls.select(F.col("control").alias("fecha"), F.lit(0).alias("event_d")).distinct())
    )


def event_panel(panel: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows of the tagged days with the tag columns.

    The tags, a row or two per event, are stored once. A semi join on the day comes first: the
    optimizer takes it below a panel's aggregation, so only rows of tagged days are summed, and a table
    partitioned by day is pruned to them at run time. Spark broadcasts the tags by their size.
    """
    tags = materialize(tags)
    return panel.join(tags.select("fecha").distinct(), "fecha", "left_semi").join(tags, "fecha")
