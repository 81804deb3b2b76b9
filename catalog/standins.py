"""Transit tables derived from the provided tables, as DataFrames and as the same SQL.

The provided tables hold no transit data. Every stand-in maps all rows of a table to the
layout the library works on; the SQL text defines the same rows for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.session import literal_table

FAR_FUTURE = "2100-01-01"

CONCERT_DAYS = [("2024-01-05", "A"), ("2024-01-12", "B"), ("2024-01-19", "C"), ("2024-01-27", "D")]
FESTIVAL_DAYS = ["2024-01-08", "2024-01-09", "2024-01-10"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- station x hour rows from the event stream ----

def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp"),
        F.to_date("ts").alias("fecha"),
        F.hour("ts").alias("hora_int"),
        ((F.col("user_id") + F.when(F.col("event_type") == "error", 1).otherwise(0)) % 12).alias("codigo_linea"),
        F.col("user_id").alias("codigo_estacion"),
        F.floor("value").cast("long").alias("entradas"),
        F.get_json_object("props", "$.k").cast("long").alias("salidas"),
    )
    return ev.withColumn("total", F.col("entradas") + F.col("salidas"))


HOURLY = r"""hourly AS (
  SELECT *, entradas + salidas AS total FROM (
    SELECT date_trunc('hour', ts) AS "timestamp", CAST(ts AS DATE) AS fecha,
           CAST(extract(hour FROM ts) AS INTEGER) AS hora_int,
           (user_id + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) % 12 AS codigo_linea,
           user_id AS codigo_estacion, CAST(floor(value) AS BIGINT) AS entradas,
           CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS salidas
    FROM events))"""


# ---- station x day rows from the order lines ----

def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("fecha"),
        (F.col("l_suppkey") % 6).alias("codigo_linea"),
        (F.col("l_suppkey") % 20).alias("codigo_estacion"),
        F.col("l_quantity").cast("long").alias("entradas"),
        F.col("l_linenumber").cast("long").alias("salidas"),
    )
    return li.withColumn("total", F.col("entradas") + F.col("salidas"))


DAILY = """daily AS (
  SELECT CAST(l_shipdate AS DATE) AS fecha, l_suppkey % 6 AS codigo_linea, l_suppkey % 20 AS codigo_estacion,
         CAST(l_quantity AS BIGINT) AS entradas, CAST(l_linenumber AS BIGINT) AS salidas,
         CAST(l_quantity AS BIGINT) + CAST(l_linenumber AS BIGINT) AS total
  FROM lineitem)"""


def unit_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line x month totals; line 4 loses 60 % in four months, a planted suspension."""
    d = daily(spark, sf_dir).groupBy("codigo_linea", F.trunc("fecha", "month").alias("mes")).agg(
        F.sum("total").cast("double").alias("total")
    )
    hit = (F.col("codigo_linea") == 4) & F.col("mes").between(F.lit(SUSPENSION[0]).cast("date"), F.lit(SUSPENSION[1]).cast("date"))
    return d.withColumns({
        "total": F.when(hit, F.col("total") * 0.4).otherwise(F.col("total")), "season": F.month("mes"),
    })


SUSPENSION = ("2000-12-01", "2001-03-01")
UNIT_MONTH = f"""unit_month AS (
  SELECT codigo_linea, mes, CAST(extract(month FROM mes) AS INTEGER) AS season,
         total * CASE WHEN codigo_linea = 4 AND mes BETWEEN DATE '{SUSPENSION[0]}' AND DATE '{SUSPENSION[1]}'
                      THEN 0.4 ELSE 1 END AS total
  FROM (SELECT codigo_linea, CAST(date_trunc('month', fecha) AS DATE) AS mes, CAST(sum(total) AS DOUBLE) AS total
        FROM daily GROUP BY 1, 2))"""


# ---- calendars and external series ----

def holidays(days: DataFrame) -> DataFrame:
    """First day of every month of the data, the first of them listed twice."""
    firsts = days.select(F.trunc("fecha", "month").alias("date")).distinct()
    first = days.agg(F.trunc(F.min("fecha"), "month").alias("date"))
    return firsts.withColumn("local_name", F.date_format("date", "yyyy-MM")).unionByName(
        first.withColumn("local_name", F.lit("doble"))
    )


def holidays_sql(days: str) -> str:
    return f"""holidays AS (
  SELECT DISTINCT CAST(date_trunc('month', fecha) AS DATE) AS date, strftime(fecha, '%Y-%m') AS local_name FROM {days}
  UNION ALL SELECT CAST(date_trunc('month', min(fecha)) AS DATE), 'doble' FROM {days})"""


def weather(days: DataFrame) -> DataFrame:
    """Four readings a day."""
    h = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("h")
    doy = F.dayofyear("fecha")
    return days.select("fecha").distinct().select("fecha", h).select(
        F.timestamp_seconds(F.unix_date("fecha").cast("long") * 86400 + F.col("h") * 21600).alias("time"),
        (((doy * 7 + F.col("h") * 5) % 23) / 4.0).alias("precipitation"),
        (F.lit(12.0) + ((doy * 5 + F.col("h")) % 11) / 2.0).alias("temperature_2m"),
    )


WEATHER = """weather AS (
  SELECT fecha, ((CAST(dayofyear(fecha) AS INTEGER) * 7 + h * 5) % 23) / 4.0::DOUBLE AS precipitation,
         12.0::DOUBLE + ((CAST(dayofyear(fecha) AS INTEGER) * 5 + h) % 11) / 2.0::DOUBLE AS temperature_2m
  FROM (SELECT DISTINCT fecha FROM daily), (SELECT unnest([0, 1, 2, 3]) AS h)),
daily_wx AS (
  SELECT fecha, sum(precipitation) AS precip_sum, max(precipitation) AS precip_max, avg(temperature_2m) AS temp_mean,
         CASE WHEN sum(precipitation) > 5 THEN 1 ELSE 0 END AS rain_day
  FROM weather GROUP BY fecha)"""


def fuel(days: DataFrame) -> DataFrame:
    months = days.select(F.trunc("fecha", "month").alias("mes")).distinct()
    start = days.agg(F.min(F.year("fecha") * 12 + F.month("fecha")).alias("_start"))
    from farebox.session import attach_row

    i = F.year("mes") * 12 + F.month("mes") - F.col("_start")
    price = (F.lit(16000) + 25 * F.floor(i / 3) + (i * 7) % 5).cast("double")
    return attach_row(months, start).select("mes", price.alias("precio_cop_gal"), F.log(price).alias("log_precio"))


FUEL = """fuel AS (
  SELECT mes, CAST(16000 + 25 * (i // 3) + (i * 7) % 5 AS DOUBLE) AS precio_cop_gal,
         ln(CAST(16000 + 25 * (i // 3) + (i * 7) % 5 AS DOUBLE)) AS log_precio
  FROM (SELECT mes, year(mes) * 12 + month(mes) - min(year(mes) * 12 + month(mes)) OVER () AS i
        FROM (SELECT DISTINCT CAST(date_trunc('month', fecha) AS DATE) AS mes FROM daily)))"""


def calendar(spark: SparkSession) -> DataFrame:
    rows = [(d, n, "concierto") for d, n in CONCERT_DAYS] + [(d, "FdV", "festival") for d in FESTIVAL_DAYS]
    return literal_table(spark, rows, "fecha date, nombre string, tipo string")


CALENDAR = "calendar AS (SELECT CAST(d AS DATE) AS fecha, nombre, tipo FROM (VALUES " + ", ".join(
    [f"('{d}', '{n}', 'concierto')" for d, n in CONCERT_DAYS] + [f"('{d}', 'FdV', 'festival')" for d in FESTIVAL_DAYS]
) + ") t(d, nombre, tipo))"


def near(facts: DataFrame) -> DataFrame:
    """Treatment tag of every station of the data."""
    return facts.select("codigo_estacion").distinct().withColumn(
        "cerca", ((F.col("codigo_estacion") * 7) % 3 == 0).cast("int")
    )


CERCA = "CASE WHEN (codigo_estacion * 7) % 3 = 0 THEN 1 ELSE 0 END"


def stations(facts: DataFrame) -> DataFrame:
    """Every station of the data with coordinates: a third within some 3 km of the venue, the others in a box around it."""
    s = facts.select("codigo_estacion").distinct()
    code, near = F.col("codigo_estacion"), F.col("codigo_estacion") % 3 == 0
    return s.select(
        "codigo_estacion",
        F.when(near, F.lit(-74.0785) + ((code * 53) % 41 - 20) / 1000.0).otherwise(F.lit(-74.2) + ((code * 53) % 100) / 400.0).alias("lon"),
        F.when(near, F.lit(4.6476) + ((code * 37) % 43 - 21) / 1000.0).otherwise(F.lit(4.5) + ((code * 37) % 100) / 400.0).alias("lat"),
    )


STATIONS = """stations AS (
  SELECT codigo_estacion,
    CASE WHEN codigo_estacion % 3 = 0 THEN -74.0785::DOUBLE + ((codigo_estacion * 53) % 41 - 20) / 1000.0::DOUBLE
         ELSE -74.2::DOUBLE + ((codigo_estacion * 53) % 100) / 400.0::DOUBLE END AS lon,
    CASE WHEN codigo_estacion % 3 = 0 THEN 4.6476::DOUBLE + ((codigo_estacion * 37) % 43 - 21) / 1000.0::DOUBLE
         ELSE 4.5::DOUBLE + ((codigo_estacion * 37) % 100) / 400.0::DOUBLE END AS lat
  FROM (SELECT DISTINCT codigo_estacion FROM hourly))"""

ROUTES = [
    [(-74.19, 4.51), (-74.12, 4.60), (-74.05, 4.62)],
    [(-74.15, 4.70), (-74.10, 4.66), (-74.10, 4.55)],
    [(-74.02, 4.52), (-73.99, 4.60), (-73.97, 4.74)],
]


def routes(spark: SparkSession) -> DataFrame:
    points = [
        F.struct(
            F.lit(i).alias("route_id"), F.lit(0).alias("part_id"),
            F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in line]).alias("points"),
        )
        for i, line in enumerate(ROUTES)
    ]
    return spark.range(1).select(F.inline(F.array(*points)))


# ---- raw text rows ----

def raw_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-file rows: the event stream as text, stations named after suppliers, lines after nations."""
    ev = table(spark, sf_dir, "events")
    line = (F.col("user_id") + F.when(F.col("event_type") == "error", 1).otherwise(0)) % 25
    return ev.select(
        F.date_format("ts", "yyyy-MM-dd").alias("Fecha_Transaccion"),
        F.date_format("ts", "HH:00:00").alias("Tiempo"),
        F.format_string("(%d)NATION_%d", line, line).alias("Linea"),
        F.format_string("(%05d)Supplier#%09d", F.col("user_id"), F.col("user_id")).alias("Estacion"),
        F.floor("value").cast("string").alias("Entradas_E"),
        F.get_json_object("props", "$.k").alias("Salidas_S"),
    )


RAW_SLOTS = r"""raw_slots AS (
  SELECT strftime(ts, '%Y-%m-%d') AS f, strftime(ts, '%H:00:00') AS t,
         (user_id + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) % 25 AS linea, user_id,
         CAST(floor(value) AS BIGINT) AS e, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS s
  FROM events)"""
