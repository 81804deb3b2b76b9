"""Small reference inputs: calendars, weather, fuel prices, stations, routes, dimensions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.schemas import EXTRA_STATIONS, WEATHER_SCHEMA
from farebox.session import literal_table
from farebox.sources.sinks import DIMS

# Numbers are read as variants: as strings, each would be fetched anew from the open file, some 12 KB at a time.
STATION_JSON = (
    "features array<struct<properties:struct<codigo_nodo_estacion:variant,nombre_estacion:string>,"
    "geometry:struct<type:string,coordinates:array<variant>>>>"
)
ROUTE_JSON = "features array<struct<geometry:struct<type:string,coordinates:string>>>"


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of holidays; a date may appear more than once."""
    raw = spark.read.schema("date string, localName string, name string").option("multiLine", True).json(path)
    return raw.select(F.to_date("date").alias("date"), F.col("localName").alias("local_name"), "name")


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Hourly precipitation and temperature."""
    raw = spark.read.schema(WEATHER_SCHEMA).option("header", True).option("enforceSchema", False).csv(path)
    return raw.withColumn("time", F.to_timestamp("time"))


def read_fuel(spark: SparkSession, path: str) -> DataFrame:
    """Monthly fuel price with its logarithm."""
    raw = spark.read.option("header", True).csv(path)
    month = F.coalesce(F.try_to_date("mes", "yyyy-MM-dd"), F.try_to_date("mes", "yyyy-MM"))
    price = F.col("precio_cop_gal").cast("double")
    return raw.select(
        F.trunc(month, "month").alias("mes"), price.alias("precio_cop_gal"), F.log(price).alias("log_precio")
    )


def read_dim(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """A dimension as (codigo, valor): one JSON object ``code -> value``, or the rows that ``write_dims`` wrote.

    A missing path gives no rows; text that is neither form is an error.
    """
    schema = f"codigo long, valor {value}"
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    names = [name for _, key, column, kind in DIMS if kind == value for name in (key, column)]
    row = "struct<" + ", ".join(f"{n}:{value if n in [d[2] for d in DIMS] else 'bigint'}" for n in dict.fromkeys(names)) + ">"
    lines = text.where("trim(value) != ''").select(F.explode(F.split("value", r"\n(?=\{)")).alias("value"))
    lines = lines.select("value", F.from_json("value", row).alias("r"), F.from_json("value", f"map<string,{value}>").alias("m"))
    keys = F.coalesce(*[F.col(f"r.{d[1]}") for d in DIMS if d[3] == value])
    values = F.coalesce(*[F.col(f"r.{d[2]}") for d in DIMS if d[3] == value])
    from_rows = lines.where(keys.isNotNull()).select(keys.alias("codigo"), values.alias("valor"))
    rest = lines.where(keys.isNull())
    checked = F.coalesce("m", F.raise_error(F.concat(F.lit("not a dimension: "), F.substring("value", 1, 80))).cast(f"map<string,{value}>"))
    from_object = rest.select(F.explode(checked).alias("codigo", "valor"))
    return from_rows.unionByName(from_object.select(F.col("codigo").cast("long").alias("codigo"), "valor"))


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON points of a file, or of all files of a folder, as rows; a task reads a file as a whole.

    Features that are not points with two coordinates give null ones.
    """
    feat = (
        spark.read.schema(STATION_JSON).option("multiLine", True).json(path)
        .select(F.explode("features").alias("f"))
    )
    point = (F.col("f.geometry.type") == "Point") & (F.size("f.geometry.coordinates") >= 2)

    def coord(i):
        return F.when(point, F.try_element_at("f.geometry.coordinates", F.lit(i)).cast("string").cast("double"))

    return feat.select(
        F.col("f.properties.codigo_nodo_estacion").cast("string").cast("double").cast("long").alias("codigo_estacion"),
        F.col("f.properties.nombre_estacion").alias("nombre_estacion"),
        coord(1).alias("lon"),
        coord(2).alias("lat"),
    )


def add_missing_stations(stations: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Append listed stations whose code the source lacks."""
    if extra is None:
        extra = literal_table(
            stations.sparkSession, EXTRA_STATIONS,
            "codigo_estacion long, nombre_estacion string, lon double, lat double",
        )
    new = extra.join(stations.select("codigo_estacion"), "codigo_estacion", "left_anti")
    return stations.unionByName(new.select(*stations.columns))


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON lines as (route_id, part_id, points array<struct<lon,lat>>)."""
    feats = (
        spark.read.schema(ROUTE_JSON).option("multiLine", True).json(path)
        .select(F.posexplode("features").alias("route_id", "f"))
    )
    coords = F.col("f.geometry.coordinates")
    parts = F.when(
        F.col("f.geometry.type") == "MultiLineString",
        F.from_json(coords, "array<array<array<double>>>"),
    ).otherwise(F.array(F.from_json(coords, "array<array<double>>")))
    points = F.transform("line", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return feats.select("route_id", F.posexplode(parts).alias("part_id", "line")).select(
        "route_id", "part_id", points.alias("points")
    )
