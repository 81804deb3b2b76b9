"""Table layouts and fixed business values."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: column names of the published files and of the fact table ----
RAW_COLUMNS = ["Fecha_Transaccion", "Tiempo", "Linea", "Estacion", "Entradas_E", "Salidas_S"]
SLOT_KEYS = ["Fecha_Transaccion", "Tiempo", "Estacion"]
FACT_COLUMNS = [
    "timestamp", "fecha", "hora", "codigo_linea", "codigo_estacion", "entradas", "salidas", "total",
]

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

FACT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("fecha", T.DateType()),
    T.StructField("hora", T.StringType()),
    T.StructField("codigo_linea", T.LongType()),
    T.StructField("codigo_estacion", T.LongType()),
    T.StructField("entradas", T.LongType()),
    T.StructField("salidas", T.LongType()),
    T.StructField("total", T.LongType()),
])

WEATHER_SCHEMA = T.StructType([
    T.StructField("time", T.StringType()),
    T.StructField("precipitation", T.DoubleType()),
    T.StructField("temperature_2m", T.DoubleType()),
])

# ---- fixed values: must equal the published rules of the data set ----

# Station variant code -> principal code.
STATION_VARIANTS = {
    40004: 40003,
    50002: 9100,
    50003: 9001,
    50008: 6000,
    57503: 7503,
    59503: 7503,
    9129: 9113,
    9125: 9119,
    9124: 9115,
}
INTERMEDIATE_GATE_LINE = "Line for Intermedium Gate"
INTERMEDIATE_GATE_NAME = "Zona G NQS Sur"
MERGED_LINE_FROM, MERGED_LINE_TO, MERGED_LINE_NAME = 39, 31, "Zona F Av. Americas"

# Stations that report validations but are missing from the published station layer.
EXTRA_STATIONS = [(9005, "Danubio", -74.121111, 4.546111)]

# Station names known without the station layer.
MANUAL_STATION_NAMES = [
    (10000, "Portal 20 de Julio"),
    (40000, "Tunal (TransMiCable)"),
    (40001, "Juan Pablo II"),
    (40002, "Manitas"),
    (40003, "Mirador del Paraíso"),
]

# Fact-table station code -> station-layer code where the two differ.
STATION_ALIASES = [(7010, 7507), (7200, 13002), (7201, 13003), (9126, 9118), (10000, 10500)]

# Event venue (lon, lat), and the limits of the distance classes in metres.
VENUE = (-74.0785, 4.6476)
DISTANCE_CLASSES = [
    (500.0, "tratada_primaria"), (1500.0, "tratada_secundaria"), (3000.0, "tratada_terciaria"),
]

# Zone letters accepted by the demand model, and the demand range used without a fitted scaler.
ZONE_LETTERS = list("ABCDEFGHJKLT")
MAX_DEMAND_FALLBACK = 980
