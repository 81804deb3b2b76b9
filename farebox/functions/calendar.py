"""Column expressions over dates and times; weekdays count from Monday = 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_width(text: Column) -> Column:
    """Whether a text is a date and a time of full width, as ``2025-01-31 07:00:00``."""
    return text.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$")


def parse_ts(date: Column | str, time: Column | str) -> Column:
    """Timestamp from two text columns, null where the text is not a date and time.

    Texts of full width, as nearly all are, take the plain cast, which is much faster than a pattern.
    """
    text = F.concat_ws(" ", date, time)
    return F.when(full_width(text), text.try_cast("timestamp")).otherwise(F.try_to_timestamp(text, F.lit("yyyy-M-d H:m:s")))


def clock_text(ts: Column | str) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def hour_of_clock(hora: Column | str) -> Column:
    """Hour of an ``HH:mm:ss`` text."""
    return F.substring(hora, 1, 2).cast("int")


def iso_week_start(day: Column | str) -> Column:
    """Monday of the ISO week: the (ISO year, week) pair as one ordered date."""
    return F.date_trunc("week", day).cast("date")


def week_number(day: Column | str) -> Column:
    """Weeks since 1970-01-05 (a Monday), so week trends stay linear across years."""
    days = F.datediff(iso_week_start(day), F.lit("1970-01-05").cast("date"))
    return (days / 7).cast("long")


def day_name(day: Column | str) -> Column:
    return F.date_format(day, "EEE")


def day_parts(df, day: str = "fecha"):
    """Add dow (Monday = 0), month, month start, ISO week and day name."""
    return df.withColumns({
        "dow": F.weekday(day),
        "month": F.month(day),
        "mes": F.trunc(day, "month"),
        "semana": F.weekofyear(day),
        "dia": day_name(day),
    })


def holiday_type(day: Column | str) -> Column:
    """Monday: bridge; Sunday: weekend; every other day, Saturday included: midweek."""
    dow = F.weekday(day)
    return (
        F.when(dow == 0, "lunes_puente").when(dow == 6, "fin_semana").otherwise("mitad_semana")
    )


def day_kind(day: Column | str) -> Column:
    return F.when(F.weekday(day) >= 5, "fds").otherwise("hab")


def in_hours(hour: Column | str, lo: int, hi: int) -> Column:
    return (F.col(hour) if isinstance(hour, str) else hour).between(lo, hi).cast("int")


def with_hours(facts):
    """Rows with ``hora_int``, taken from the clock text of the fact table where it is absent."""
    return facts if "hora_int" in facts.columns else facts.withColumn("hora_int", hour_of_clock("hora"))
