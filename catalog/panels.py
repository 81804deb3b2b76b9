"""Panels, weather and fuel joins, KPI tables and spatial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import standins as S
from catalog.sqltools import r
from farebox.functions.calendar import day_parts
from farebox.functions.geo import EPSG_3116
from farebox.functions.numeric import distance_bin
from farebox.operators import panels as P
from farebox.operators.dims import line_stations
from farebox.operators.spatial import distance_to_point, nearest_n_per_class, within_distance_of_lines
from farebox.plans import fuel as fuel_plan
from farebox.plans import kpis
from farebox.plans import weather as weather_plan
from farebox.schemas import VENUE
from farebox.session import literal_table


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


Q = {}


def query(sql):
    def add(fn):
        Q[fn.__name__] = (fn, sql)
        return fn
    return add


@query(f"WITH {S.DAILY} SELECT fecha, CAST(sum(total) AS BIGINT) AS total FROM daily GROUP BY 1")
def daily_total(spark, sf):
    return P.daily_total(S.daily(spark, sf))


@query(f"""WITH {S.DAILY} SELECT codigo_estacion, fecha, CAST(sum(total) AS BIGINT) AS total FROM daily
GROUP BY 1, 2 HAVING sum(total) > 0""")
def station_day(spark, sf):
    return P.station_day(S.daily(spark, sf))


@query(f"""WITH {S.HOURLY} SELECT codigo_estacion, fecha, hora_int, CAST(sum(total) AS BIGINT) AS total FROM hourly GROUP BY 1, 2, 3""")
def station_hour(spark, sf):
    return P.station_hour(S.hourly(spark, sf))


@query(f"WITH {S.DAILY} SELECT codigo_linea, fecha, CAST(sum(total) AS BIGINT) AS total FROM daily GROUP BY 1, 2")
def line_day(spark, sf):
    return P.line_day(S.daily(spark, sf))


@query(f"""WITH {S.DAILY}, d AS (SELECT DISTINCT fecha FROM daily)
SELECT fecha, CAST(isodow(fecha) - 1 AS INTEGER) AS dow, CAST(month(fecha) AS INTEGER) AS month,
       CAST(date_trunc('month', fecha) AS DATE) AS mes, CAST(week(fecha) AS INTEGER) AS semana, strftime(fecha, '%a') AS dia FROM d""")
def calendar_parts(spark, sf):
    return day_parts(S.daily(spark, sf).select("fecha").distinct())


MONTHLY = f"""{S.DAILY}, {S.holidays_sql('daily')},
day_total AS (SELECT fecha, sum(total) AS total FROM daily GROUP BY 1),
monthly AS (SELECT *, val_mes / n_dias AS val_dia, ln(val_mes) AS log_val, ln(val_mes / n_dias) AS log_val_d,
    row_number() OVER (ORDER BY mes) AS trend
  FROM (SELECT CAST(date_trunc('month', fecha) AS DATE) AS mes, CAST(sum(total) AS DOUBLE) AS val_mes, count(*) AS n_dias,
          count(*) FILTER (fecha IN (SELECT date FROM holidays)) AS n_festivos FROM day_total GROUP BY 1))"""


def monthly(spark, sf):
    d = S.daily(spark, sf)
    return P.monthly_rollup(P.daily_total(d), S.holidays(d))


@query(f"""WITH {MONTHLY} SELECT mes, CAST(val_mes AS BIGINT) AS val_mes, n_dias, n_festivos, {r('val_dia')} AS val_dia,
{r('log_val')} AS log_val, {r('log_val_d')} AS log_val_d, trend FROM monthly""")
def monthly_rollup(spark, sf):
    out = rounded(monthly(spark, sf), "val_dia", "log_val", "log_val_d")
    return out.withColumns({"n_festivos": F.col("n_festivos").cast("long"), "trend": F.col("trend").cast("long")})


PANEL = f"""{S.DAILY}, {S.WEATHER}, {S.holidays_sql('daily')},
panel AS (SELECT p.*, precip_sum, precip_max, temp_mean, rain_day, ln(total) AS log_total
  FROM (SELECT codigo_estacion, fecha, sum(total) AS total FROM daily WHERE fecha NOT IN (SELECT date FROM holidays) GROUP BY 1, 2) p
  LEFT JOIN daily_wx USING (fecha) WHERE total > 0)"""


def weather_panel(spark, sf):
    d = S.daily(spark, sf)
    return weather_plan.weather_panel(d, S.weather(d), S.holidays(d))


@query(f"""WITH {PANEL} SELECT codigo_estacion, fecha, CAST(total AS BIGINT) AS total, {r('precip_sum')} AS precip_sum,
{r('precip_max')} AS precip_max, {r('temp_mean')} AS temp_mean, rain_day, {r('log_total')} AS log_total FROM panel""")
def daily_weather_join(spark, sf):
    return rounded(weather_panel(spark, sf), "precip_sum", "precip_max", "temp_mean", "log_total")


@query(f"""WITH {PANEL} SELECT fecha, {r('avg(log_total)')} AS log_mean, {r('max(precip_sum)')} AS precip, max(rain_day) AS rain,
{r('max(temp_mean)')} AS temp FROM panel GROUP BY 1""")
def rain_scatter(spark, sf):
    return rounded(weather_plan.system_rain_scatter(weather_panel(spark, sf)), "log_mean", "precip", "temp")


@query(f"""WITH {PANEL}, s AS (SELECT fecha, avg(log_total) AS y, max(precip_sum) AS x FROM panel GROUP BY 1)
SELECT {r('regr_slope(y, x)')} AS slope, {r('regr_intercept(y, x)')} AS intercept FROM s""")
def rain_trend(spark, sf):
    s = weather_plan.system_rain_scatter(weather_panel(spark, sf))
    return rounded(weather_plan.simple_trend(s, "log_mean", "precip"), "slope", "intercept")


@query(f"""WITH {S.DAILY}, {S.WEATHER}
SELECT count(*) AS n_dias, CAST(sum(rain_day) AS BIGINT) AS n_lluvia, {r('avg(rain_day) * 100')} AS pct_lluvia,
  {r('avg(precip_sum) FILTER (rain_day = 1)')} AS precip_lluvia, {r('avg(precip_sum) FILTER (rain_day = 0)')} AS precip_seco,
  {r('min(temp_mean)')} AS temp_min, {r('max(temp_mean)')} AS temp_max, {r('avg(temp_mean)')} AS temp_media FROM daily_wx""")
def kpi_period_counts(spark, sf):
    out = kpis.period_counts(P.daily_weather(S.weather(S.daily(spark, sf))))
    return rounded(out, "pct_lluvia", "precip_lluvia", "precip_seco", "temp_min", "temp_max", "temp_media")


@query(f"""WITH {S.DAILY}, {S.FUEL} SELECT min(precio_cop_gal) AS precio_min, max(precio_cop_gal) AS precio_max,
{r('max(precio_cop_gal) / min(precio_cop_gal) - 1')} AS variacion, count(DISTINCT precio_cop_gal) AS niveles FROM fuel""")
def kpi_price_range(spark, sf):
    return rounded(kpis.price_range(S.fuel(S.daily(spark, sf))), "variacion")


PRICE = f"""{MONTHLY}, {S.FUEL}, price AS (SELECT monthly.*, precio_cop_gal, log_precio FROM monthly JOIN fuel USING (mes)),
diffs AS (SELECT *, log_val - lag(log_val) OVER w AS d_log_val, log_val_d - lag(log_val_d) OVER w AS d_log_val_d,
  log_precio - lag(log_precio) OVER w AS d_log_precio, n_festivos - lag(n_festivos) OVER w AS d_n_festivos
  FROM price WINDOW w AS (ORDER BY mes)),
diff AS (SELECT * FROM diffs WHERE d_log_val IS NOT NULL)"""


def price_frame(spark, sf):
    return fuel_plan.price_frame(monthly(spark, sf), S.fuel(S.daily(spark, sf)))


@query(f"""WITH {PRICE} SELECT mes, precio_cop_gal, trend, {r('log_precio')} AS log_precio, {r('d_log_val')} AS d_log_val,
{r('d_log_val_d')} AS d_log_val_d, {r('d_log_precio')} AS d_log_precio, d_n_festivos FROM diff""")
def fuel_join_diff(spark, sf):
    df = fuel_plan.differences(price_frame(spark, sf))
    df = df.select("mes", "precio_cop_gal", F.col("trend").cast("long").alias("trend"), "log_precio", "d_log_val",
                   "d_log_val_d", "d_log_precio", F.col("d_n_festivos").cast("long").alias("d_n_festivos"))
    return rounded(df, "log_precio", "d_log_val", "d_log_val_d", "d_log_precio")


@query(f"WITH {PRICE} SELECT {r('corr(log_precio, trend)')} AS r, {r('corr(log_precio, trend) ^ 2')} AS r2 FROM price")
def price_corr(spark, sf):
    return rounded(fuel_plan.price_trend_correlation(price_frame(spark, sf)), "r", "r2")


@query(f"WITH {S.DAILY}, t AS (SELECT fecha, sum(total) AS total FROM daily GROUP BY 1) SELECT {r('avg(total)')} AS mean, "
       f"CAST(min(total) AS BIGINT) AS min, CAST(max(total) AS BIGINT) AS max, CAST(max(total) - min(total) AS BIGINT) AS range, "
       f"{r('var_pop(total)', 4)} AS var FROM t")
def daily_moments(spark, sf):
    out = P.moments(P.daily_total(S.daily(spark, sf)), "total")
    return out.withColumns({"mean": F.round("mean", 6), "var": F.round("var", 4)})


# ---- KPI tables ----

def line_names(spark, sf):
    # Keys are moved by four, so that the smallest line codes have no name.
    return S.table(spark, sf, "nation").select((F.col("n_nationkey") + 4).cast("long").alias("codigo_linea"), F.col("n_name").alias("nombre_linea"))


def station_names(spark, sf):
    return S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("codigo_estacion"), F.col("s_name").alias("nombre_estacion"))


LINE_NAME = "coalesce((SELECT n_name FROM nation WHERE n_nationkey + 4 = codigo_linea), 'Línea ' || codigo_linea)"
STATION_NAME = "coalesce((SELECT s_name FROM supplier WHERE s_suppkey = codigo_estacion), 'Estación ' || codigo_estacion)"


def dots(x):
    return f"translate(format('{{:,}}', CAST({x} AS BIGINT)), ',', '.')"


@query(f"""WITH {S.HOURLY}, d AS (SELECT sum(total) AS total FROM hourly GROUP BY fecha), a AS (SELECT avg(total) AS m FROM d)
SELECT {r('m')} AS promedio_diario, {dots('floor(m)')} AS texto FROM a""")
def kpi_mean_daily(spark, sf):
    return rounded(kpis.mean_daily(S.hourly(spark, sf)), "promedio_diario")


def top_sql(key, extra, cte=S.HOURLY, source="hourly"):
    return f"""WITH {cte}, t AS (SELECT {key}, CAST(sum(total) AS BIGINT) AS total FROM {source} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT {key}, total, {extra} FROM t"""


@query(top_sql("codigo_linea", f"{LINE_NAME} AS nombre_linea"))
def kpi_top_line(spark, sf):
    return kpis.top_line(S.hourly(spark, sf), line_names(spark, sf))


@query(top_sql("hora_int", "printf('%02d:00 - %02d:00', hora_int, (hora_int + 1) % 24) AS franja"))
def kpi_peak_hour(spark, sf):
    return kpis.peak_hour(S.hourly(spark, sf))


@query(top_sql("codigo_estacion", f"{STATION_NAME} AS nombre_estacion"))
def kpi_top_station(spark, sf):
    return kpis.top_station(S.hourly(spark, sf), station_names(spark, sf))


@query(f"""WITH {S.HOURLY}, p AS (SELECT codigo_linea, codigo_estacion, sum(total) AS total FROM hourly GROUP BY 1, 2),
t AS (SELECT codigo_linea, sum(total) AS total_linea FROM p GROUP BY 1),
top AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY codigo_linea ORDER BY total DESC, codigo_estacion) = 1)
SELECT codigo_linea, {LINE_NAME} AS "Linea", {STATION_NAME} AS "Top_Estacion", {dots('total_linea')} AS "Entradas",
  CAST(total_linea AS BIGINT) AS total_linea FROM t JOIN top USING (codigo_linea)""")
def kpi_line_table(spark, sf):
    return kpis.line_table(S.hourly(spark, sf), line_names(spark, sf), station_names(spark, sf))


ALIASES = [(7, 100007), (8, 9), (12, 100012)]


@query(f"""WITH {S.HOURLY}, l AS (SELECT codigo_estacion, min(codigo_linea) AS codigo_linea FROM hourly GROUP BY 1),
s AS (SELECT codigo_estacion, {LINE_NAME} AS nombre_linea, e, n FROM
  (SELECT codigo_estacion, sum(entradas) AS e, count(DISTINCT fecha) AS n FROM hourly GROUP BY 1) JOIN l USING (codigo_estacion)),
a AS (SELECT * FROM (VALUES {', '.join(map(str, ALIASES))}) t(c, alias)),
u AS (SELECT * FROM s WHERE codigo_estacion NOT IN (SELECT alias FROM a JOIN s ON c = codigo_estacion)
  UNION ALL SELECT alias, nombre_linea, e, n FROM s JOIN a ON codigo_estacion = c)
SELECT codigo_estacion, nombre_linea, CAST(round(e / n) AS BIGINT) AS promedio_diario, CAST(e AS BIGINT) AS total_entradas FROM u""")
def kpi_station_stats(spark, sf):
    h = S.hourly(spark, sf)
    aliases = literal_table(spark, ALIASES, "codigo_estacion long, alias long")
    return kpis.station_stats(h, line_stations(h), line_names(spark, sf), aliases)


# ---- geography ----

def tm_sql(lon, lat):
    """The projection series with its constants written out."""
    c = EPSG_3116
    m0, m2, m4, m6 = c.meridian_terms()
    e2, ep2 = c.e2, c.e2 / (1 - c.e2)
    import math
    phi, lam = f"radians({lat})", f"radians({lon})"
    n = f"({c.a!r} / sqrt(1 - {e2!r} * sin({phi}) ** 2))"
    t, cc = f"(tan({phi}) ** 2)", f"({ep2!r} * cos({phi}) ** 2)"
    a = f"(({lam} - {math.radians(c.lon0)!r}) * cos({phi}))"
    x = f"({c.false_east!r} + {n} * ({a} + (1 - {t} + {cc}) * {a} ** 3 / 6 + (5 - 18 * {t} + {t} ** 2 + 72 * {cc} - {58 * ep2!r}) * {a} ** 5 / 120))"
    arc = f"({c.a!r} * ({m0!r} * {phi} - {m2!r} * sin(2 * {phi}) + {m4!r} * sin(4 * {phi}) - {m6!r} * sin(6 * {phi})))"
    y = (f"({c.false_north!r} + {arc} - {c.meridian_arc(math.radians(c.lat0))!r} + {n} * tan({phi}) * ({a} ** 2 / 2 "
         f"+ (5 - {t} + 9 * {cc} + 4 * {cc} ** 2) * {a} ** 4 / 24 + (61 - 58 * {t} + {t} ** 2 + 600 * {cc} - {330 * ep2!r}) * {a} ** 6 / 720))")
    return x, y


def _xy(lon, lat):
    x, y = tm_sql(lon, lat)
    return f"{x} AS x, {y} AS y"


DIST = f"""{S.HOURLY}, {S.STATIONS}, v AS (SELECT {_xy(f'CAST({VENUE[0]} AS DOUBLE)', f'CAST({VENUE[1]} AS DOUBLE)')}),
st AS (SELECT codigo_estacion, {_xy('lon', 'lat')} FROM stations),
dist AS (SELECT codigo_estacion, d AS dist_m, CASE WHEN d <= 500 THEN 'tratada_primaria' WHEN d <= 1500 THEN 'tratada_secundaria'
   WHEN d <= 3000 THEN 'tratada_terciaria' ELSE 'control' END AS grupo,
   CASE WHEN d > 0 AND d <= 500 THEN 1 WHEN d > 500 AND d <= 1500 THEN 2 WHEN d > 1500 AND d <= 3000 THEN 3 END AS dist_bin
  FROM (SELECT codigo_estacion, sqrt((st.x - v.x) ** 2 + (st.y - v.y) ** 2) AS d FROM st, v))"""


def distances(spark, sf):
    return distance_to_point(S.stations(S.hourly(spark, sf)))


@query(f"WITH {DIST} SELECT codigo_estacion, {r('dist_m', 3)} AS dist_m, grupo, dist_bin FROM dist")
def distance_bands(spark, sf):
    d = distances(spark, sf).withColumn("dist_bin", distance_bin("dist_m", [0, 500, 1500, 3000]))
    return d.select("codigo_estacion", F.round("dist_m", 3).alias("dist_m"), "grupo", "dist_bin")


@query(f"""WITH {DIST} SELECT grupo, codigo_estacion, {r('dist_m', 3)} AS dist_m FROM dist
QUALIFY row_number() OVER (PARTITION BY grupo ORDER BY dist_m, codigo_estacion) <= 5""")
def nearest_per_class(spark, sf):
    return nearest_n_per_class(distances(spark, sf)).select("grupo", "codigo_estacion", F.round("dist_m", 3).alias("dist_m"))


_segments = [(*line[i], *line[i + 1]) for line in S.ROUTES for i in range(len(line) - 1)]
NEAR = f"""{S.HOURLY}, {S.STATIONS}, st AS (SELECT codigo_estacion, {_xy('lon', 'lat')} FROM stations),
ll AS (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, CAST(d AS DOUBLE) AS d
  FROM (VALUES {', '.join(map(str, _segments))}) t(a, b, c, d)),
sg AS (SELECT {tm_sql('a', 'b')[0]} AS ax, {tm_sql('a', 'b')[1]} AS ay, {tm_sql('c', 'd')[0]} AS bx, {tm_sql('c', 'd')[1]} AS by_ FROM ll),
q AS (SELECT codigo_estacion, x, y, ax, ay, bx - ax AS dx, by_ - ay AS dy FROM st, sg),
f AS (SELECT *, greatest(0.0, least(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) AS t FROM q),
m AS (SELECT codigo_estacion, min(sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2)) AS d FROM f GROUP BY 1)"""


@query(f"""WITH {NEAR} SELECT codigo_estacion, CASE WHEN d <= 500 THEN {r('d', 3)} END AS dist_m,
CASE WHEN d <= 500 THEN 1 ELSE 0 END AS cerca FROM m""")
def near_route(spark, sf):
    out = within_distance_of_lines(S.stations(S.hourly(spark, sf)), S.routes(spark))
    return out.select("codigo_estacion", F.round("dist_m", 3).alias("dist_m"), "cerca")


QUERIES = Q
