"""Queries that write inputs to the shared folder and read them back through the library."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from catalog import cleaning, panels
from catalog import standins as S
from catalog.sqltools import r
from farebox.operators import clean, dims
from farebox.plans import etl, kpis
from farebox.schemas import RAW_COLUMNS
from farebox.session import checkpoint_dir, materialize, scratch
from farebox.sources import facts, raw, reference, sinks
from farebox.streaming.ingest import ingest_incremental

Q = {}


def query(sql=None):
    def add(fn):
        Q[fn.__name__] = (fn, sql)
        return fn
    return add


def folder(spark):
    return f"{checkpoint_dir(spark)}/roundtrip-{uuid.uuid4().hex}"


# Rows of a JSON document written for the readers: 1.4 MB of station points.
DOCUMENT_ROWS = 10_000


def write_documents(rows, document, path):
    """The rows as JSON documents of some ``DOCUMENT_ROWS`` rows, a file for each; ``document`` makes one of a list of rows."""
    with scratch(rows.sparkSession):
        rows = materialize(rows)
        files = rows.count() // DOCUMENT_ROWS + 1
        dealt = rows.groupBy(F.pmod(F.xxhash64(*rows.columns), F.lit(files)))
        documents = dealt.agg(F.to_json(document(F.collect_list(F.struct(*rows.columns)))).alias("value")).select("value")
        documents.write.option("maxRecordsPerFile", 1).text(path)


SLOTS = f"slots AS ({cleaning.SLOT_SQL})"
FACTS = "SELECT fecha, hora, codigo_linea, codigo_estacion, entradas, salidas, total FROM slots"


def shown(df):
    return df.drop("timestamp")


@query(f"WITH {SLOTS} {FACTS}")
def etl_facts(spark, sf):
    out = folder(spark)
    S.raw_slots(spark, sf).write.option("header", True).csv(f"{out}/raw")
    etl.run_from_csv(spark, f"{out}/raw", out)
    return shown(facts.read_validations(spark, f"{out}/validations"))


@query(f"WITH {SLOTS} {FACTS}")
def archives_facts(spark, sf):
    """A ZIP for each day, one of them twice, all with a member that can't be used."""

    def pack(table: pa.Table) -> pa.Table:
        day = table.column("Fecha_Transaccion")[0].as_py()
        lines = [",".join(RAW_COLUMNS)] + [",".join(row) for row in zip(*(table.column(c).to_pylist() for c in RAW_COLUMNS))]
        paths = [day] + ([f"{day}-otra"] if day.endswith("05") else [])
        content = io.BytesIO()
        with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(f"salidas{day}.csv", "\n".join(lines))
            archive.writestr(f"otra{day}.csv", "a,b\n1,2\n")
        return pa.table({"path": paths, "content": pa.array([content.getvalue()] * len(paths), pa.binary())})

    files = S.raw_slots(spark, sf).groupBy("Fecha_Transaccion").applyInArrow(pack, "path string, content binary")
    rows = raw.extracted_rows(raw.extract_from(files))
    return shown(clean.clean(rows)).drop("nombre_linea", "nombre_estacion")


@query(f"WITH {SLOTS} SELECT fecha, hora, codigo_estacion, entradas, salidas, total FROM slots")
def ingest_facts(spark, sf):
    """Two files of another order and with another column, taken in by two runs of the stream."""
    out, rows = folder(spark), S.raw_slots(spark, sf)
    half = F.pmod(F.xxhash64(*RAW_COLUMNS), F.lit(2))
    for part, columns in enumerate((RAW_COLUMNS, ["Acceso", *reversed(RAW_COLUMNS)])):
        new = rows.where(half == part).withColumn("Acceso", F.lit("x")).select(*columns)
        new.write.mode("append").option("header", True).csv(f"{out}/raw")
        ingest_incremental(spark, f"{out}/raw", f"{out}/facts", f"{out}/stream", dims=f"{out}/dims")
    return shown(facts.regroup_slots(facts.read_validations(spark, f"{out}/facts"))).drop("codigo_linea")


@query(f"WITH {SLOTS} SELECT fecha, hora, codigo_estacion, entradas, salidas, total FROM slots")
def compacted_facts(spark, sf):
    """The table after two loads, each day made one load again."""
    out, rows = folder(spark), S.raw_slots(spark, sf)
    half = F.pmod(F.xxhash64(*RAW_COLUMNS), F.lit(2))
    for part in (0, 1):
        facts.write_validations(clean.clean(rows.where(half == part)), f"{out}/facts", load=part, laid_out=True)
    facts.compact_days(spark, f"{out}/facts")
    return shown(facts.read_validations(spark, f"{out}/facts")).drop("codigo_linea")


@query(f"""WITH {SLOTS} SELECT DISTINCT 'dim_linea' AS tabla, codigo_linea AS codigo, 'Nation_' || codigo_linea AS valor FROM slots
UNION ALL SELECT DISTINCT 'dim_estacion', codigo_estacion, 'Supplier#' || lpad(CAST(codigo_estacion AS VARCHAR), 9, '0') FROM slots
UNION ALL SELECT 'linea_estaciones', codigo_linea, array_to_string(list_sort(list(DISTINCT codigo_estacion)), ',') FROM slots GROUP BY 2""")
def dims_round_trip(spark, sf):
    out = folder(spark)
    sinks.write_dims(*dims.build_dimensions(clean.clean(S.raw_slots(spark, sf))), out)
    parts = []
    for name, _, _, kind in sinks.DIMS:
        rows = reference.read_dim(spark, f"{out}/{name}", kind)
        value = F.array_join(F.col("valor").cast("array<string>"), ",") if kind != "string" else F.col("valor")
        parts.append(rows.select(F.lit(name).alias("tabla"), "codigo", value.alias("valor")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(panels.Q["kpi_line_table"][1])
def kpi_job(spark, sf):
    """The line table as the KPI job leaves it."""
    out, hourly = folder(spark), S.hourly(spark, sf)
    kpis.run(hourly, panels.line_names(spark, sf), dims.line_stations(hourly), panels.station_names(spark, sf), out)
    return spark.read.json(f"{out}/tabla_troncales").select("codigo_linea", "Linea", "Top_Estacion", "Entradas", "total_linea")


DAYS = f"{S.DAILY}, {S.holidays_sql('daily')}"


@query(f"WITH {DAYS} SELECT date, local_name, local_name AS name FROM holidays")
def holidays_file(spark, sf):
    out = folder(spark)
    rows = S.holidays(S.daily(spark, sf)).select(F.col("date").cast("string").alias("date"), F.col("local_name").alias("localName"), F.col("local_name").alias("name"))
    write_documents(rows, lambda listed: listed, out)
    return reference.read_holidays(spark, out)


@query(f"WITH {S.DAILY}, {S.WEATHER} SELECT fecha, count(*) AS n, {r('sum(precipitation)')} AS lluvia, {r('avg(temperature_2m)')} AS temp FROM weather GROUP BY 1")
def weather_file(spark, sf):
    out = folder(spark)
    rows = S.weather(S.daily(spark, sf)).withColumn("time", F.date_format("time", "yyyy-MM-dd'T'HH:mm"))
    rows.write.option("header", True).csv(out)
    return reference.read_weather(spark, out).groupBy(F.to_date("time").alias("fecha")).agg(
        F.count("*").alias("n"), F.round(F.sum("precipitation"), 6).alias("lluvia"), F.round(F.avg("temperature_2m"), 6).alias("temp")
    )


@query(f"WITH {S.DAILY}, {S.FUEL} SELECT mes, precio_cop_gal, {r('log_precio')} AS log_precio FROM fuel")
def fuel_file(spark, sf):
    out = folder(spark)
    S.fuel(S.daily(spark, sf)).drop("log_precio").write.option("header", True).csv(out)
    return reference.read_fuel(spark, out).withColumn("log_precio", F.round("log_precio", 6))


@query(f"WITH {S.HOURLY}, {S.STATIONS} SELECT codigo_estacion, 'E' || codigo_estacion AS nombre_estacion, {r('lon')} AS lon, {r('lat')} AS lat FROM stations")
def stations_file(spark, sf):
    out = folder(spark)
    rows = S.stations(S.hourly(spark, sf)).select(
        F.struct(F.col("codigo_estacion").cast("string").alias("codigo_nodo_estacion"),
                 F.concat(F.lit("E"), F.col("codigo_estacion").cast("string")).alias("nombre_estacion")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
    )
    write_documents(rows, lambda listed: F.struct(listed.alias("features")), out)
    return reference.read_stations(spark, out).withColumns({c: F.round(c, 6) for c in ("lon", "lat")})


@query(f"""WITH {S.HOURLY}, {S.CALENDAR} SELECT fecha, CAST(sum(entradas) AS BIGINT) AS entradas, count(*) AS n
FROM hourly WHERE fecha IN (SELECT fecha FROM calendar) GROUP BY 1""")
def event_days_only(spark, sf):
    """Only the days of the event calendar are read back from the table."""
    out = folder(spark)
    rows = S.hourly(spark, sf).withColumn("hora", F.date_format("timestamp", "HH:mm:ss"))
    facts.write_validations(rows, out)
    read = facts.read_dates(spark, out, S.calendar(spark))
    return read.groupBy("fecha").agg(F.sum("entradas").alias("entradas"), F.count("*").alias("n"))


@query(f"""WITH {SLOTS} SELECT 'linea' AS tabla, codigo_linea AS codigo, nombre_linea AS nombre, count(*) AS len FROM slots GROUP BY 2, 3
UNION ALL SELECT 'estacion', codigo_estacion, nombre_estacion, count(*) FROM slots GROUP BY 2, 3""")
def legacy_names(spark, sf):
    old = clean.derive_fields(clean.aggregate_slots(S.raw_slots(spark, sf)))
    _, lines, stations = facts.migrate_legacy(old)
    tag = lambda df, name: df.toDF("codigo", "nombre", "len").select(F.lit(name).alias("tabla"), "codigo", "nombre", "len")
    return tag(lines, "linea").unionByName(tag(stations, "estacion"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE regexp_matches(s_name, '(1|7)$')")
def names_by_pattern(spark, sf):
    return S.table(spark, sf, "supplier").where(F.col("s_name").rlike("(1|7)$")).select("s_suppkey", "s_name")


QUERIES = Q
