"""Cleaning, dimensions and index queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import standins as S
from farebox.functions.text import display_name, head_to_portal, name_of, code_of, normalize_name
from farebox.operators import clean, dims
from farebox.sources.raw import links_from_index
from farebox.sources.reference import add_missing_stations

VARIANTS = {1: 0, 11: 10, 21: 20, 31: 30}


def slot_aggregate(spark, sf):
    out = clean.derive_fields(clean.aggregate_slots(S.raw_slots(spark, sf)))
    return out.drop("timestamp")


SLOT_SQL = f"""WITH {S.RAW_SLOTS}
SELECT CAST(f AS DATE) AS fecha, t AS hora,
       CAST(regexp_extract(min('(' || linea || ')NATION_' || linea), '\\((\\d+)\\)', 1) AS BIGINT) AS codigo_linea,
       regexp_extract(min('(' || linea || ')NATION_' || linea), '\\)(.+)', 1) AS nombre_linea,
       user_id AS codigo_estacion, 'Supplier#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS nombre_estacion,
       CAST(sum(e) AS BIGINT) AS entradas, CAST(sum(s) AS BIGINT) AS salidas, CAST(sum(e) + sum(s) AS BIGINT) AS total
FROM raw_slots GROUP BY f, t, user_id"""


def split_station_names(spark, sf):
    label = F.concat(F.lit("("), F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), F.lit(")  CABECERA "),
                     F.col("s_name"), F.lit(" - C.C. ÑUÑOA mirador"))
    raw = S.table(spark, sf, "supplier").select(label.alias("e"), F.col("s_suppkey"), "s_name")
    return raw.select(
        code_of("e").alias("codigo_estacion"),
        normalize_name(name_of("e")).alias("normal"),
        head_to_portal(normalize_name(name_of("e"))).alias("nombre_estacion"),
        display_name(F.concat(F.lit("("), F.col("s_suppkey").cast("string"), F.lit(")"), F.col("s_suppkey").cast("string"), F.lit(" - "), F.col("s_name"))).alias("visible"),
    )


SPLIT_SQL = r"""WITH e AS (
  SELECT s_suppkey, s_name, '(' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || ')  CABECERA ' || s_name || ' - C.C. ÑUÑOA mirador' AS e
  FROM supplier),
n AS (SELECT s_suppkey, s_name, CAST(regexp_extract(e, '\((\d+)\)', 1) AS BIGINT) AS codigo_estacion,
    translate(trim(array_to_string([upper(w[1]) || w[2:] FOR w IN
      regexp_extract_all(lower(regexp_extract(e, '\)(.+)', 1)), '[\p{L}\p{N}]+|[^\p{L}\p{N}]+')], '')),
      'áàâäéèêëíìîïóòôöúùûüñÁÉÍÓÚÑ', 'aaaaeeeeiiiioooouuuunAEIOUN') AS normal
  FROM e)
SELECT codigo_estacion, normal, regexp_replace(normal, '^Cabecera', 'Portal') AS nombre_estacion, s_name AS visible FROM n"""


def _lines(spark, sf):
    h = S.hourly(spark, sf)
    return h.withColumns({
        "codigo_linea": F.col("codigo_linea") + 30,
        "nombre_linea": F.when(F.col("codigo_linea") == 5, "Line for Intermedium Gate")
        .otherwise(F.concat(F.lit("Zona "), F.col("codigo_linea").cast("string"))),
    })


def recode_lines(spark, sf):
    out = clean.recode_lines(_lines(spark, sf))
    return out.groupBy("codigo_linea", "nombre_linea").agg(F.sum("total").alias("total"), F.count("*").alias("n"))


RECODE_SQL = f"""WITH {S.HOURLY},
l AS (SELECT codigo_linea + 30 AS c, CASE WHEN codigo_linea = 5 THEN 'Zona G NQS Sur' ELSE 'Zona ' || codigo_linea END AS n, total FROM hourly)
SELECT CASE WHEN c = 39 THEN 31 ELSE c END AS codigo_linea, CASE WHEN c = 39 THEN 'Zona F Av. Americas' ELSE n END AS nombre_linea,
       CAST(sum(total) AS BIGINT) AS total, count(*) AS n
FROM l GROUP BY 1, 2"""


def _slots(spark, sf):
    h = S.hourly(spark, sf)
    return h.groupBy("timestamp", "fecha", "hora_int", "codigo_estacion").agg(
        F.min("codigo_linea").alias("codigo_linea"), *[F.sum(c).alias(c) for c in ("entradas", "salidas", "total")]
    )


SLOTS = f"""{S.HOURLY},
slots AS (SELECT "timestamp", fecha, hora_int, codigo_estacion, min(codigo_linea) AS codigo_linea,
  CAST(sum(entradas) AS BIGINT) AS entradas, CAST(sum(salidas) AS BIGINT) AS salidas, CAST(sum(total) AS BIGINT) AS total
  FROM hourly GROUP BY ALL),
m AS (SELECT * FROM (VALUES {', '.join(f'({a}, {b})' for a, b in VARIANTS.items())}) t(v, p))"""


def variants_parity(spark, sf):
    return clean.consolidate_variants(_slots(spark, sf), VARIANTS).drop("timestamp")


PARITY_SQL = f"""WITH {SLOTS},
va AS (SELECT "timestamp", p, sum(entradas) AS e, sum(salidas) AS s, sum(total) AS t
       FROM slots JOIN m ON codigo_estacion = v GROUP BY ALL)
SELECT fecha, hora_int, codigo_estacion, codigo_linea, CAST(entradas + coalesce(e, 0) AS BIGINT) AS entradas,
       CAST(salidas + coalesce(s, 0) AS BIGINT) AS salidas, CAST(total + coalesce(t, 0) AS BIGINT) AS total
FROM slots LEFT JOIN va ON slots."timestamp" = va."timestamp" AND codigo_estacion = p
WHERE codigo_estacion NOT IN (SELECT v FROM m)"""


def variants_regroup(spark, sf):
    out = clean.consolidate_variants(_slots(spark, sf).drop("codigo_linea"), VARIANTS, mode="regroup")
    return out.drop("timestamp")


REGROUP_SQL = f"""WITH {SLOTS}
SELECT fecha, hora_int, coalesce(p, codigo_estacion) AS codigo_estacion, CAST(sum(entradas) AS BIGINT) AS entradas,
       CAST(sum(salidas) AS BIGINT) AS salidas, CAST(sum(total) AS BIGINT) AS total
FROM slots LEFT JOIN m ON codigo_estacion = v GROUP BY 1, 2, 3"""


def _named(spark, sf):
    ev = S.table(spark, sf, "events")
    return ev.select(
        (F.col("user_id") % 12).alias("codigo_linea"),
        F.concat(F.lit(" cabecera ÑANDÚ "), F.upper("event_type")).alias("nombre_linea"),
    )


def dim_most_frequent_name(spark, sf):
    counts = dims.name_counts(_named(spark, sf), "codigo_linea", "nombre_linea")
    return dims.most_frequent_name(
        dims.normalized_counts(counts, "codigo_linea", "nombre_linea", portal=True), "codigo_linea", "nombre_linea"
    )


FREQUENT_SQL = """WITH c AS (
  SELECT user_id % 12 AS codigo_linea, 'Portal Nandu ' || upper(event_type[1]) || event_type[2:] AS nombre_linea, count(*) AS n
  FROM events GROUP BY 1, 2)
SELECT codigo_linea, nombre_linea FROM c
QUALIFY row_number() OVER (PARTITION BY codigo_linea ORDER BY n DESC, nombre_linea) = 1"""


def line_station_lists(spark, sf):
    lists = dims.line_stations(S.hourly(spark, sf))
    return lists.select("codigo_linea", F.array_join(F.col("estaciones").cast("array<string>"), ",").alias("estaciones"))


LISTS_SQL = f"""WITH {S.HOURLY}
SELECT codigo_linea, array_to_string(list_sort(list(DISTINCT codigo_estacion)), ',') AS estaciones
FROM hourly GROUP BY 1"""


def first_line_of_station(spark, sf):
    return dims.first_line_of_station(dims.line_stations(S.hourly(spark, sf)))


FIRST_LINE_SQL = f"WITH {S.HOURLY} SELECT codigo_estacion, min(codigo_linea) AS codigo_linea FROM hourly GROUP BY 1"


def dim_upsert(spark, sf):
    old = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("codigo"), F.col("s_name").alias("nombre"))
    new = S.table(spark, sf, "customer").select((F.col("c_custkey") + 50).alias("codigo"), F.col("c_name").alias("nombre"))
    return dims.upsert_dim(old, new, "codigo", "nombre")


UPSERT_SQL = """SELECT coalesce(c_custkey + 50, s_suppkey) AS codigo, coalesce(c_name, s_name) AS nombre
FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey + 50"""


def missing_stations(spark, sf):
    known = S.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("codigo_estacion"), F.col("s_name").alias("nombre_estacion"),
        F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"),
    )
    extra = S.stations(S.hourly(spark, sf)).withColumn("nombre_estacion", F.lit("nueva"))
    out = add_missing_stations(known, extra)
    return out.withColumns({c: F.round(c, 6) for c in ("lon", "lat")})


MISSING_SQL = f"""WITH {S.HOURLY}, {S.STATIONS}
SELECT s_suppkey AS codigo_estacion, s_name AS nombre_estacion, CAST(NULL AS DOUBLE) AS lon, CAST(NULL AS DOUBLE) AS lat FROM supplier
UNION ALL
SELECT codigo_estacion, 'nueva', round(lon, 6), round(lat, 6) FROM stations WHERE codigo_estacion NOT IN (SELECT s_suppkey FROM supplier)"""


def index_links(spark, sf):
    return links_from_index(S.table(spark, sf, "pages"), pattern='href="(/[A-Za-z]+)"', prefix="/").select(
        "name", "first_page", F.col("first_pos").cast("long").alias("first_pos"), "mentions"
    )


LINKS_SQL = """WITH a AS (SELECT page_id, regexp_extract_all(html, 'href="(/[A-Za-z]+)"', 1) AS l FROM pages),
u AS (SELECT page_id, unnest(l) AS name, generate_subscripts(l, 1) - 1 AS pos FROM a)
SELECT name, page_id AS first_page, pos AS first_pos, count(*) OVER (PARTITION BY name) AS mentions FROM u
QUALIFY row_number() OVER (PARTITION BY name ORDER BY page_id, pos) = 1"""

QUERIES = {
    "slot_aggregate": (slot_aggregate, SLOT_SQL),
    "split_station_names": (split_station_names, SPLIT_SQL),
    "recode_lines": (recode_lines, RECODE_SQL),
    "variants_parity": (variants_parity, PARITY_SQL),
    "variants_regroup": (variants_regroup, REGROUP_SQL),
    "dim_most_frequent_name": (dim_most_frequent_name, FREQUENT_SQL),
    "line_station_lists": (line_station_lists, LISTS_SQL),
    "first_line_of_station": (first_line_of_station, FIRST_LINE_SQL),
    "dim_upsert": (dim_upsert, UPSERT_SQL),
    "missing_stations": (missing_stations, MISSING_SQL),
    "index_links": (index_links, LINKS_SQL),
}
