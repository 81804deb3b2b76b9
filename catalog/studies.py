"""Event calendars, event studies, fixed effects, DiD and price regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import standins as S
from catalog.panels import DIST, PANEL, PRICE, distances, price_frame, rounded, weather_panel
from catalog.sqltools import coef_select, ols_ctes, p_f, p_t, p_z, r, stars_sql
from farebox.operators import events as E
from farebox.operators import panels as P
from farebox.operators.dims import line_stations
from farebox.plans import fuel as fuel_plan
from farebox.plans import holidays as hol
from farebox.plans import openstreets as streets
from farebox.plans import venue
from farebox.plans import weather as weather_plan

Q = {}


def query(sql=None):
    def add(fn):
        Q[fn.__name__] = (fn, sql)
        return fn
    return add


# ---- holiday offsets and effects on the daily total ----

KS = list(range(-5, 6))


def name(k, group=""):
    return f'"{hol.term(k, group)}"'


def offsets_sql(column, holiday_filter="true"):
    """The sorted days since events, from -5 to 5, of each day of ``t``."""
    days = f"SELECT list_sort(list(DISTINCT CAST(t.fecha - h.date AS INTEGER))) FROM holidays h WHERE t.fecha - h.date BETWEEN -5 AND 5 AND {holiday_filter}"
    return f"coalesce(({days}), []) AS {column}"


def indicators_sql(column, group=""):
    return ", ".join(f"CASE WHEN list_contains({column}, {k}) THEN 1 ELSE 0 END AS {name(k, group)}" for k in KS)


DOW_M = [f"dow_{i}" for i in range(1, 7)] + [f"month_{i}" for i in range(2, 13)]
CONTROLS_SQL = ", ".join(
    [f"CASE WHEN isodow(fecha) - 1 = {i} THEN 1.0 ELSE 0.0 END AS dow_{i}" for i in range(1, 7)]
    + [f"CASE WHEN month(fecha) = {i} THEN 1.0 ELSE 0.0 END AS month_{i}" for i in range(2, 13)]
)
EVENT_DAYS = f"""{S.DAILY}, {S.holidays_sql('daily')},
day_total AS (SELECT fecha, sum(total) AS total FROM daily GROUP BY 1),
ev AS (SELECT t.fecha, t.total, ln(t.total) AS log_total, {offsets_sql('offsets')}, {CONTROLS_SQL} FROM day_total t),
off AS (SELECT *, {indicators_sql('offsets')}, len(offsets) AS n_overlap FROM ev)"""


def day_and_holidays(spark, sf):
    d = S.daily(spark, sf)
    return P.daily_total(d), S.holidays(d)


@query(f"""WITH {EVENT_DAYS} SELECT fecha, CAST(total AS BIGINT) AS total, array_to_string(offsets, ',') AS offsets, CAST(n_overlap AS INTEGER) AS n_overlap,
CASE isodow(fecha) WHEN 1 THEN 'lunes_puente' WHEN 7 THEN 'fin_semana' ELSE 'mitad_semana' END AS tipo FROM off""")
def event_offsets(spark, sf):
    out = E.event_time_join(*day_and_holidays(spark, sf)).withColumn("tipo", hol.holiday_type("fecha"))
    return out.withColumn("offsets", F.array_join("offsets", ","))


MEDIANS = f"""{EVENT_DAYS}, med AS (SELECT isodow(fecha) AS d, median(total) AS m FROM off WHERE n_overlap = 0 GROUP BY 1),
ind AS (SELECT fecha, local_name, strftime(fecha, '%a') AS dia,
  CASE isodow(fecha) WHEN 1 THEN 'lunes_puente' WHEN 7 THEN 'fin_semana' ELSE 'mitad_semana' END AS tipo,
  CAST(total AS BIGINT) AS total, round((total / m - 1) * 100, 1) + 0.0 AS efecto_pct
  FROM holidays JOIN day_total ON fecha = date LEFT JOIN med ON isodow(fecha) = d)"""


@query(f"WITH {MEDIANS} SELECT * FROM ind")
def holiday_vs_median(spark, sf):
    return hol.individual_effects(*day_and_holidays(spark, sf))


@query(f"WITH {MEDIANS} SELECT tipo, count(*) AS n, {r('avg(efecto_pct)')} AS efecto_medio FROM ind GROUP BY 1")
def holiday_effect_by_type(spark, sf):
    return rounded(hol.effects_by_type(hol.individual_effects(*day_and_holidays(spark, sf))), "efecto_medio")


TERMS = [name(k) for k in hol.STUDIED]


def offset_select(fit, first, digits=6):
    """Rows per offset k; position of the term in the fit is first + index."""
    rows = ", ".join(f"({k}, {first + hol.STUDIED.index(k) if k in hol.STUDIED else 0})" for k in KS)
    z = 1.959963984540054
    return f"""SELECT CAST(k AS INTEGER) AS k, CASE WHEN i = 0 THEN 0.0 WHEN f.kept[i] THEN {r('f.b[i]', digits)} END AS b,
  CASE WHEN i = 0 THEN 0.0 WHEN f.kept[i] THEN {r(f'f.b[i] - {z} * sqrt(c.v[i][i])', digits)} END AS lo,
  CASE WHEN i = 0 THEN 0.0 WHEN f.kept[i] THEN {r(f'f.b[i] + {z} * sqrt(c.v[i][i])', digits)} END AS hi,
  CASE WHEN i <> 0 AND f.kept[i] AND c.v[i][i] > 0 THEN (SELECT {r(p_z('s'), digits)} FROM (SELECT f.b[i] / sqrt(c.v[i][i]) AS s)) END AS p,
  CASE WHEN i = 0 THEN 0.0 WHEN f.kept[i] THEN {r('(exp(f.b[i]) - 1) * 100', 4)} END AS pct
FROM {fit}_fit f, {fit}_cov c, (VALUES {rows}) t(k, i)"""


@query(f"WITH RECURSIVE {EVENT_DAYS}, {ols_ctes('off', DOW_M + TERMS, 'log_total')} {offset_select('ols', len(DOW_M) + 1)}")
def daily_event_study(spark, sf):
    out = hol.event_study_daily(*day_and_holidays(spark, sf)).select("k", "b", "lo", "hi", "p", "pct")
    return rounded(out, "b", "lo", "hi", "p").withColumn("pct", F.round("pct", 4))


PRE = [name(k) for k in hol.STUDIED if k < hol.BASELINE]
F_SQL = f"""WITH RECURSIVE {EVENT_DAYS},
{ols_ctes('off', DOW_M + TERMS, 'log_total', cov='nonrobust', name='full')},
{ols_ctes('off', DOW_M + [t for t in TERMS if t not in PRE], 'log_total', cov='nonrobust', name='small')},
k AS (SELECT f.n - len(list_filter(f.kept, lambda t: t)) - 1 AS df, len(list_filter(f.kept, lambda t: t)) - len(list_filter(s.kept, lambda t: t)) AS q
  FROM full_fit f, small_fit s)
SELECT q, df_resid, {r('f')} AS f, {r(p_f('f', 'q', 'df_resid'))} AS p
FROM (SELECT CAST(q AS INTEGER) AS q, df AS df_resid, ((b.rss - a.rss) / q) / (a.rss / df) AS f FROM full_s a, small_s b, k)"""


@query(F_SQL)
def pretrend_f(spark, sf):
    return rounded(hol.pretrend_test(*day_and_holidays(spark, sf)), "f", "p")


LUN, MID = ([name(k, group) for k in hol.STUDIED] for group in hol.SUBGROUPS)
KIND = "CASE isodow(h.date) WHEN 1 THEN 'lun_' WHEN 7 THEN 'fds' ELSE 'mid_' END"
SUB = f"""{S.DAILY}, {S.holidays_sql('daily')},
day_total AS (SELECT fecha, sum(total) AS total FROM daily GROUP BY 1),
days_off AS (SELECT t.*, {offsets_sql('lun', KIND + " = 'lun_'")}, {offsets_sql('mid', KIND + " = 'mid_'")} FROM day_total t),
sub AS (SELECT fecha, ln(total) AS log_total, {indicators_sql('lun', 'lun_')}, {indicators_sql('mid', 'mid_')}, {CONTROLS_SQL} FROM days_off),
{ols_ctes('sub', DOW_M + LUN + MID, 'log_total', name='sg')}"""


@query(f"""WITH RECURSIVE {SUB}, lun AS ({offset_select('sg', len(DOW_M) + 1)}), mid AS ({offset_select('sg', len(DOW_M) + 1 + len(LUN))})
SELECT 'lunes_puente' AS tipo, * FROM lun UNION ALL SELECT 'mitad_semana', * FROM mid""")
def event_study_subgroups(spark, sf):
    out = hol.event_study_subgroups(*day_and_holidays(spark, sf)).select("tipo", "k", "b", "lo", "hi", "p", "pct")
    return rounded(out, "b", "lo", "hi", "p").withColumn("pct", F.round("pct", 4))


def _pos(column):
    return len(DOW_M) + 1 + (LUN + MID).index(column)


_tests = ", ".join(f"('k={k:+d}', {_pos(name(k, 'lun_'))}, {_pos(name(k, 'mid_'))})" for k in (0, 1, 2))


@query(f"""WITH RECURSIVE {SUB} SELECT restriction, {r('estimate')} AS estimate, {r('w', 4)} AS f, {r(p_f('w', '1', 'd'))} AS p
FROM (SELECT label AS restriction, f.b[i] - f.b[j] AS estimate, f.n - len(list_filter(f.kept, lambda t: t)) - 1 AS d,
  (f.b[i] - f.b[j]) ^ 2 / (c.v[i][i] + c.v[j][j] - 2 * c.v[i][j]) AS w
FROM sg_fit f, sg_cov c, (VALUES {_tests}) t(label, i, j))""")
def subgroup_equality(spark, sf):
    out = hol.subgroup_equality(*day_and_holidays(spark, sf)).select("restriction", "estimate", "f", "p")
    return out.withColumns({"estimate": F.round("estimate", 6), "f": F.round("f", 4), "p": F.round("p", 6)})


# ---- weather ----

WX = f"{PANEL}, wx AS (SELECT codigo_estacion, fecha, log_total, precip_sum, rain_day, temp_mean, {CONTROLS_SQL} FROM panel)"
_wx_terms = [("precip_sum", "wp"), ("rain_day", "wr")]
_wx_fits = ", ".join(
    ols_ctes("wx", DOW_M + [rain, "temp_mean"], "log_total", absorb="codigo_estacion", cov="cluster", cluster="codigo_estacion", name=n)
    for rain, n in _wx_terms
)


def weather_sql(digits=6):
    rows = " UNION ALL ".join(
        coef_select(n, len(DOW_M) + i, extra=f"'{rain}' AS modelo, '{t}' AS term, ", critical=1.96,
                    df="(SELECT count(DISTINCT codigo_estacion) FROM wx)", digits=digits)
        for rain, n in _wx_terms for i, t in ((1, rain), (2, "temp_mean"))
    )
    return f"WITH RECURSIVE {WX}, {_wx_fits} {rows}"


@query(weather_sql())
def weather_fe(spark, sf):
    out = weather_plan.weather_effect(weather_panel(spark, sf)).select("modelo", "term", "b", "se", "lo", "hi", "p", "n")
    return rounded(out, "b", "se", "lo", "hi", "p")


BYLINE = f"""{WX}, bridge AS (SELECT DISTINCT codigo_linea, codigo_estacion FROM daily),
wl AS (SELECT * FROM wx JOIN bridge USING (codigo_estacion)),
{ols_ctes('wl', DOW_M + ['precip_sum', 'temp_mean'], 'log_total', by=['codigo_linea'], name='wl')}"""


@query(f"""WITH RECURSIVE {BYLINE}
SELECT f.codigo_linea, coalesce(n_name, 'Línea ' || f.codigo_linea) AS nombre_linea, {r(f'f.b[{len(DOW_M) + 1}]')} AS b,
  {r(f'sqrt(c.v[{len(DOW_M) + 1}][{len(DOW_M) + 1}])')} AS se,
  {r(f'(exp(f.b[{len(DOW_M) + 1}] * 10) - 1) * 100', 2)} AS pct_10mm,
  (SELECT {r(p_z('s'), 4)} FROM (SELECT f.b[{len(DOW_M) + 1}] / sqrt(c.v[{len(DOW_M) + 1}][{len(DOW_M) + 1}]) AS s)) AS p, f.n
FROM wl_fit f JOIN wl_cov c ON f.codigo_linea = c.codigo_linea LEFT JOIN nation ON n_nationkey + 4 = f.codigo_linea
WHERE f.n >= 500""")
def weather_by_line(spark, sf):
    from catalog.panels import line_names

    lists = line_stations(S.daily(spark, sf))
    return weather_plan.effect_by_line(weather_panel(spark, sf), lists, line_names(spark, sf))


# ---- fuel price ----

PRICE_X = ["log_precio", "trend", "n_festivos"]


@query(f"""WITH RECURSIVE {PRICE}, {ols_ctes('price', PRICE_X, 'log_val', name='pa')}, {ols_ctes('price', PRICE_X, 'log_val_d', name='pb')}
{' UNION ALL '.join(coef_select(n, i, extra=f"'{y}' AS modelo, '{t}' AS term, ") for n, y in (('pa', 'log_val'), ('pb', 'log_val_d')) for i, t in enumerate(PRICE_X, 1))}""")
def price_ols(spark, sf):
    out = fuel_plan.monthly_price_ols(price_frame(spark, sf)).select("modelo", "term", "b", "se", "lo", "hi", "p", "n")
    return rounded(out, "b", "se", "lo", "hi", "p")


@query(f"WITH RECURSIVE {PRICE}, {ols_ctes('diff', ['d_log_precio'], 'd_log_val_d', name='pd')} "
       + f"SELECT *, {stars_sql('p', 'ns')} AS sig FROM (" + coef_select("pd", 1, extra="'d_log_precio' AS term, ") + ")")
def price_diff_ols(spark, sf):
    out = fuel_plan.first_difference_ols(price_frame(spark, sf)).select("term", "b", "se", "lo", "hi", "p", "n", "sig")
    return rounded(out, "b", "se", "lo", "hi", "p")


@query(f"""WITH RECURSIVE {PRICE}, {ols_ctes('price', PRICE_X, 'log_val', cov='nonrobust', name='pv')}
SELECT term, {r('g.d[i] * f.a[i][i]')} AS vif, g.d[i] * f.a[i][i] > 10 AS severa
FROM pv_fit f, pv_g g, (VALUES {', '.join(f"('{t}', {i})" for i, t in enumerate(PRICE_X, 1))}) t(term, i)""")
def vif_table(spark, sf):
    return rounded(fuel_plan.vif_table(price_frame(spark, sf)), "vif")


# ---- open-street Sundays ----

DPANEL = f"""{S.DAILY}, dp AS (SELECT codigo_estacion, fecha, total, ln(total) AS log_total, {S.CERCA} AS cerca,
  CASE WHEN isodow(fecha) = 7 THEN 1 ELSE 0 END AS is_sunday,
  CASE WHEN isodow(fecha) = 7 THEN {S.CERCA} ELSE 0 END AS cerca_x_sunday, {CONTROLS_SQL}
  FROM (SELECT codigo_estacion, fecha, sum(total) AS total FROM daily GROUP BY 1, 2) WHERE total > 0)"""
HOURS = [f"h_{h}" for h in range(7, 21)]


def hpanel(weekday):
    return f"""{S.HOURLY}, hp AS (SELECT codigo_estacion, hora_int, ln(total) AS log_total, {S.CERCA} AS cerca,
  CASE WHEN hora_int BETWEEN 7 AND 13 THEN {S.CERCA} ELSE 0 END AS cerca_x_ventana,
  {', '.join(f'CASE WHEN hora_int = {h} THEN 1.0 ELSE 0.0 END AS h_{h}' for h in range(7, 21))}
  FROM (SELECT codigo_estacion, fecha, hora_int, sum(total) AS total FROM hourly WHERE isodow(fecha) = {weekday + 1} GROUP BY 1, 2, 3)
  WHERE total > 0), hw AS (SELECT * FROM hp WHERE hora_int BETWEEN 6 AND 20)"""


def did_sql(base, source, x, controls, spec, name="did", digits=6):
    fit = ols_ctes(source, controls + [x], "log_total", absorb="codigo_estacion", cov="cluster", cluster="codigo_estacion", name=name)
    return f"WITH RECURSIVE {base}, {fit} " + coef_select(name, len(controls) + 1, extra=f"'{spec}' AS spec, '{x}' AS term, ", critical=1.96, df=f"(SELECT count(DISTINCT codigo_estacion) FROM {source})", digits=digits)


def did_out(df):
    return rounded(df.select("spec", "term", "b", "se", "lo", "hi", "p", "n"), "b", "se", "lo", "hi", "p")


@query(did_sql(DPANEL, "dp", "cerca_x_sunday", DOW_M, "domingo x cerca"))
def did_sunday(spark, sf):
    d = S.daily(spark, sf)
    return did_out(streets.did_two_way(d, S.near(d)))


@query(did_sql(DPANEL, "dp", "cerca_x_sunday", [], "domingo x cerca"))
def did_sunday_plain(spark, sf):
    d = S.daily(spark, sf)
    return did_out(streets.did_two_way(d, S.near(d), with_controls=False))


@query(did_sql(hpanel(6), "hw", "cerca_x_ventana", HOURS, "ventana domingos"))
def did_window(spark, sf):
    h = S.hourly(spark, sf)
    return did_out(streets.did_window(h, S.near(h)))


@query(did_sql(hpanel(5), "hw", "cerca_x_ventana", HOURS, "placebo sábados"))
def did_placebo(spark, sf):
    h = S.hourly(spark, sf)
    return did_out(streets.did_placebo(h, S.near(h)))


def daily_panel(spark, sf):
    d = S.daily(spark, sf)
    return streets.daily_panel(d, S.near(d))


@query(f"""WITH {DPANEL} SELECT cerca, CAST(isodow(fecha) - 1 AS INTEGER) AS dow, {r('avg(log_total)')} AS log_mean FROM dp GROUP BY 1, 2""")
def dow_profile(spark, sf):
    return rounded(streets.dow_means(daily_panel(spark, sf)), "log_mean")


RATIO = f"""{DPANEL}, ra AS (SELECT cerca, avg(total) FILTER (is_sunday = 0) AS weekday, avg(total) FILTER (is_sunday = 1) AS sunday FROM dp GROUP BY 1)"""


@query(f"WITH {RATIO} SELECT cerca, {r('weekday')} AS weekday, {r('sunday')} AS sunday, {r('sunday / weekday')} AS ratio FROM ra")
def sunday_ratio(spark, sf):
    return rounded(streets.sunday_weekday_ratio(daily_panel(spark, sf)), "weekday", "sunday", "ratio")


@query(f"""WITH {RATIO}, q AS (SELECT max(sunday / weekday) FILTER (cerca = 1) AS a, max(sunday / weekday) FILTER (cerca = 0) AS b FROM ra)
SELECT {r('a')} AS ratio_cerca, {r('b')} AS ratio_lejos, {r('a - b')} AS diferencia FROM q""")
def sunday_ratio_difference(spark, sf):
    out = streets.ratio_difference(streets.sunday_weekday_ratio(daily_panel(spark, sf)))
    return rounded(out, "ratio_cerca", "ratio_lejos", "diferencia")


@query(f"""WITH {DPANEL}, w AS (SELECT CASE WHEN isodow(fecha) = 7 THEN 'd' WHEN isodow(fecha) <= 5 THEN 'l' END AS s,
  date_diff('day', DATE '1970-01-05', CAST(date_trunc('week', fecha) AS DATE)) // 7 + 1 AS sem, cerca, log_total FROM dp),
g AS (SELECT s, sem, avg(log_total) FILTER (cerca = 1) AS t, avg(log_total) FILTER (cerca = 0) AS c FROM w WHERE s IS NOT NULL GROUP BY 1, 2),
k AS (SELECT s, sem, t, c, t - c AS gap FROM g WHERE t IS NOT NULL AND c IS NOT NULL),
a AS (SELECT count(*) FILTER (s = 'd') AS n, corr(t, c) FILTER (s = 'd') AS rho, regr_slope(gap, sem) FILTER (s = 'd') AS slope,
  corr(gap, sem) FILTER (s = 'd') AS r, avg(gap) FILTER (s = 'd') - avg(gap) FILTER (s = 'l') AS did FROM k)
SELECT n AS n_semanas, {r('rho')} AS rho, {r('slope', 8)} AS slope, {r('tt')} AS t, {r(p_t('tt', '(n - 2)'))} AS p, {r('did')} AS did_naive,
  {r('(exp(did) - 1) * 100')} AS did_pct FROM (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS tt FROM a)""")
def parallel_trends(spark, sf):
    out = streets.parallel_trends(daily_panel(spark, sf))
    return rounded(out, "rho", "t", "p", "did_naive", "did_pct").withColumn("slope", F.round("slope", 8))


@query(f"""WITH {hpanel(6)}, m AS (SELECT cerca, hora_int, avg(log_total) AS y FROM hp GROUP BY 1, 2),
p AS (SELECT cerca, avg(y) AS post FROM m WHERE hora_int >= 14 GROUP BY 1), n AS (SELECT hora_int, cerca, y - post AS z FROM m JOIN p USING (cerca)),
o AS (SELECT hora_int, max(z) FILTER (cerca = 0) AS a, max(z) FILTER (cerca = 1) AS b FROM n GROUP BY 1)
SELECT hora_int, {r('a')} AS lejos, {r('b')} AS cerca, {r('b - a')} AS diff FROM o WHERE a IS NOT NULL AND b IS NOT NULL""")
def hourly_gap(spark, sf):
    h = S.hourly(spark, sf)
    return rounded(streets.hourly_gap_profile(streets.hourly_panel(h, S.near(h), streets.SUNDAY)), "lejos", "cerca", "diff")


# ---- venue events ----

NEVER = "SELECT fecha FROM calendar UNION SELECT date FROM holidays"
VENUE_BASE = f"""{S.HOURLY}, {S.CALENDAR}, {S.holidays_sql('hourly')}, days AS (SELECT DISTINCT fecha FROM hourly),
fest AS (SELECT fecha FROM calendar WHERE tipo = 'festival' AND fecha NOT IN (SELECT date FROM holidays)),
conc AS (SELECT fecha FROM calendar WHERE tipo = 'concierto'),
ok AS (SELECT fecha FROM days WHERE fecha NOT IN ({NEVER})),
each AS (SELECT c.fecha AS evento, d.fecha AS control, CAST(isodow(d.fecha) - 1 AS INTEGER) AS dow, abs(date_diff('day', d.fecha, c.fecha)) AS dist
  FROM conc c, ok d WHERE isodow(c.fecha) = isodow(d.fecha)),
each5 AS (SELECT *, row_number() OVER (PARTITION BY evento ORDER BY dist, control) AS orden FROM each QUALIFY orden <= 5),
pool AS (SELECT dow, control, min(dist) AS dist FROM (SELECT CAST(isodow(d.fecha) - 1 AS INTEGER) AS dow, d.fecha AS control,
  abs(date_diff('day', d.fecha, f.fecha)) AS dist FROM fest f, ok d WHERE isodow(f.fecha) = isodow(d.fecha)) GROUP BY 1, 2),
pool4 AS (SELECT *, row_number() OVER (PARTITION BY dow ORDER BY dist, control) AS orden FROM pool QUALIFY orden <= 4),
sh AS (SELECT codigo_estacion, fecha, hora_int, sum(total) AS total FROM hourly GROUP BY 1, 2, 3),
cp AS (SELECT sh.*, 1 AS event_d FROM sh WHERE fecha IN (SELECT fecha FROM conc)
  UNION ALL SELECT sh.*, 0 FROM sh WHERE fecha IN (SELECT control FROM each5)),
fp AS (SELECT sh.*, 1 AS event_d FROM sh WHERE fecha IN (SELECT fecha FROM fest)
  UNION ALL SELECT sh.*, 0 FROM sh WHERE fecha IN (SELECT control FROM pool4)),
cpl AS (SELECT *, ln(greatest(total, 1)) AS log_total FROM cp), fpl AS (SELECT *, ln(greatest(total, 1)) AS log_total FROM fp)"""


class Venue:
    """The venue study's inputs over all stations of the hourly stand-in."""

    def __init__(self, spark, sf):
        self.facts = S.hourly(spark, sf)
        self.panel = P.station_hour(self.facts)
        self.days = self.facts.select("fecha").distinct()
        self.calendar = S.calendar(spark)
        self.holidays = S.holidays(self.facts)

    def concert_controls(self):
        return venue.concert_controls(self.calendar, self.holidays, self.days)

    def festival_controls(self):
        return venue.festival_controls(self.calendar, self.holidays, self.days)

    def concert_panel(self):
        return venue.study_panel(self.panel, venue.concerts(self.calendar), self.concert_controls())

    def festival_panel(self):
        return venue.study_panel(self.panel, venue.festival_days(self.calendar, self.holidays), self.festival_controls())

    def nights(self):
        return venue.night_ratios(self.panel, self.calendar, self.days)

    def big_nights(self):
        """Synthetic nights are even, so a lower threshold than the default marks some of them."""
        return venue.detect_big_events(self.nights(), threshold=1.2)

    def big_panel(self):
        nights = self.big_nights()
        controls = venue.big_night_controls(nights, self.calendar, self.holidays, self.days)
        return venue.study_panel(self.panel, nights, controls)


@query(f"WITH {VENUE_BASE} SELECT evento, control, dow, CAST(dist AS INTEGER) AS dist, CAST(orden AS INTEGER) AS orden FROM each5")
def matched_controls_each(spark, sf):
    return Venue(spark, sf).concert_controls()


@query(f"WITH {VENUE_BASE} SELECT dow, control, CAST(dist AS INTEGER) AS dist, CAST(orden AS INTEGER) AS orden FROM pool4")
def matched_controls_pooled(spark, sf):
    return Venue(spark, sf).festival_controls()


NIGHTS = f"""{VENUE_BASE},
nt AS (SELECT fecha, CAST(coalesce(sum(total) FILTER (hora_int = 18), 0) AS BIGINT) AS h18,
  CAST(coalesce(sum(total) FILTER (hora_int = 20), 0) AS BIGINT) AS h20,
  CAST(coalesce(sum(total) FILTER (hora_int = 23), 0) AS BIGINT) AS h23 FROM sh GROUP BY 1),
tg AS (SELECT nt.*, CASE WHEN fecha IN (SELECT fecha FROM conc) THEN 'concierto'
    WHEN fecha IN (SELECT fecha FROM calendar WHERE tipo = 'festival') THEN 'FdV' ELSE 'normal' END AS categoria,
  (SELECT max(nombre) FROM calendar c WHERE c.fecha = nt.fecha) AS etiqueta FROM nt),
nr AS (SELECT tg.*, h23 / (SELECT avg(h23) FROM tg WHERE categoria = 'normal') AS r23, h18 / (SELECT avg(h18) FROM tg WHERE categoria = 'normal') AS r18 FROM tg),
big AS (SELECT fecha, strftime(fecha, '%a') AS dia, r23, h23 FROM nr WHERE r23 > 1.2 AND categoria = 'normal'),
bc AS (SELECT b.fecha AS evento, d.fecha AS control, CAST(isodow(d.fecha) - 1 AS INTEGER) AS dow, CAST(abs(date_diff('day', d.fecha, b.fecha)) AS INTEGER) AS dist
  FROM big b, ok d WHERE isodow(b.fecha) = isodow(d.fecha) AND b.fecha <> d.fecha),
bc5 AS (SELECT *, CAST(row_number() OVER (PARTITION BY evento ORDER BY dist, control) AS INTEGER) AS orden FROM bc QUALIFY orden <= 5)"""


@query(f"WITH {NIGHTS} SELECT fecha, h18, h20, h23, {r('r23')} AS r23, {r('r18')} AS r18, etiqueta, categoria FROM nr")
def night_ratios(spark, sf):
    return rounded(Venue(spark, sf).nights(), "r23", "r18")


@query(f"WITH {NIGHTS} SELECT fecha, dia, {r('r23')} AS r23, h23 FROM big")
def big_nights(spark, sf):
    return rounded(Venue(spark, sf).big_nights(), "r23")


@query(f"WITH {NIGHTS} SELECT * FROM bc5")
def matched_controls_detected(spark, sf):
    v = Venue(spark, sf)
    return venue.big_night_controls(v.big_nights(), v.calendar, v.holidays, v.days)


PROF = f"""{VENUE_BASE}, cb AS (SELECT fecha, hora_int, event_d, sum(total) AS total FROM cp GROUP BY 1, 2, 3),
pr AS (SELECT hora_int, event_d, avg(total) AS mean, stddev_samp(total) AS std, count(*) AS n FROM cb GROUP BY 1, 2)"""


@query(f"""WITH {PROF} SELECT hora_int, event_d, {r('mean')} AS mean, {r('std')} AS std, n AS count, {r('std / sqrt(n)')} AS se,
{r('mean - 1.96 * (std / sqrt(n))')} AS lo, {r('mean + 1.96 * (std / sqrt(n))')} AS hi FROM pr""")
def hour_profile(spark, sf):
    return rounded(venue.hour_profile(Venue(spark, sf).concert_panel()), "mean", "std", "se", "lo", "hi")


@query(f"""WITH {PROF}, x AS (SELECT hora_int, max(mean) FILTER (event_d = 1) AS e, max(mean) FILTER (event_d = 0) AS c FROM pr GROUP BY 1)
SELECT hora_int, {r('e')} AS evento, {r('c')} AS control, {r('e - c')} AS exceso FROM x WHERE e IS NOT NULL AND c IS NOT NULL""")
def event_excess(spark, sf):
    out = venue.event_excess(venue.hour_profile(Venue(spark, sf).concert_panel()))
    return rounded(out, "evento", "control", "exceso")


PROFILES = f"""{PROF}, ct AS (SELECT isodow(fecha) AS d, hora_int, avg(total) AS c FROM cb WHERE event_d = 0 GROUP BY 1, 2),
gr AS (SELECT c.fecha, c.nombre, CAST(h AS INTEGER) AS hora_int FROM calendar c, range(24) t(h)
  WHERE c.fecha IN (SELECT fecha FROM cb WHERE event_d = 1)),
ep AS (SELECT g.fecha, nombre, g.hora_int, CAST(coalesce(cb.total, 0) AS BIGINT) AS evento, coalesce(ct.c, 0) AS control FROM gr g
  LEFT JOIN cb ON cb.fecha = g.fecha AND cb.hora_int = g.hora_int AND event_d = 1
  LEFT JOIN ct ON ct.d = isodow(g.fecha) AND ct.hora_int = g.hora_int)"""


@query(f"WITH {PROFILES} SELECT fecha, nombre, hora_int, evento, {r('control')} AS control FROM ep")
def event_profiles(spark, sf):
    v = Venue(spark, sf)
    return rounded(venue.event_profiles(v.concert_panel(), venue.concerts(v.calendar)), "control")


@query(f"""WITH {PROFILES} SELECT fecha, nombre, evento, {r('control')} AS control, {r('evento / control')} AS ratio FROM ep
WHERE hora_int = 23 AND control > 0""")
def event_ratio_23(spark, sf):
    v = Venue(spark, sf)
    out = venue.event_ratio_at_hour(v.concert_panel(), venue.concerts(v.calendar))
    return rounded(out, "control", "ratio")


FRATIO = f"""{VENUE_BASE}, pc AS (SELECT isodow(fecha) AS d, avg(total) FILTER (hora_int = 20) AS c20, avg(total) FILTER (hora_int = 23) AS c23
  FROM fp WHERE event_d = 0 GROUP BY 1),
fv AS (SELECT fecha, coalesce(sum(total) FILTER (hora_int = 20), 0) AS v20, coalesce(sum(total) FILTER (hora_int = 23), 0) AS v23
  FROM fp WHERE event_d = 1 GROUP BY 1),
ns AS (SELECT count(DISTINCT codigo_estacion) AS n FROM hourly),
fr AS (SELECT fecha, strftime(fecha, '%a') AS dia, CASE WHEN isodow(fecha) >= 6 THEN 'fds' ELSE 'hab' END AS tipo,
  CAST(v20 AS BIGINT) AS v20, c20 * n AS c20, CASE WHEN c20 > 0 THEN v20 / (c20 * n) END AS r20,
  CAST(v23 AS BIGINT) AS v23, c23 * n AS c23, CASE WHEN c23 > 0 THEN v23 / (c23 * n) END AS r23
  FROM fv LEFT JOIN pc ON d = isodow(fecha), ns)"""


@query(f"WITH {FRATIO} SELECT fecha, dia, tipo, v20, {r('c20')} AS c20, {r('r20')} AS r20, v23, {r('c23')} AS c23, {r('r23')} AS r23 FROM fr")
def festival_ratios(spark, sf):
    v = Venue(spark, sf)
    return rounded(venue.festival_ratios(v.festival_panel(), v.panel), "c20", "r20", "c23", "r23")


@query(f"WITH {FRATIO} SELECT tipo, {r('avg(r20)')} AS r20, {r('avg(r23)')} AS r23 FROM fr GROUP BY 1")
def festival_ratio_means(spark, sf):
    v = Venue(spark, sf)
    return rounded(venue.festival_ratio_means(venue.festival_ratios(v.festival_panel(), v.panel)), "r20", "r23")


def hourly_fit_sql(base, source, by, min_rows=6, min_treated=0, cov="hc3", dense=False, bands=True, digits=6):
    """Event study by group, thin groups left out (or null, on a full set of hours)."""
    fit = ols_ctes(source, ["event_d"], "log_total", by=by, absorb="codigo_estacion", cov=cov, name="ev")
    keys = ", ".join(by)
    sizes = f"""sz AS (SELECT {keys}, count(*) AS rws, sum(event_d) AS trt, count(DISTINCT event_d) AS lv FROM {source} GROUP BY {keys})"""
    coef = f"co AS ({coef_select('ev', 1, by, digits=digits)})"
    cols = f"co.b, co.se, {'co.lo, co.hi, co.p, ' if bands else ''}{r('(exp(fb) - 1) * 100', 4)} AS pct, co.n"
    raw = f"raw AS (SELECT {keys}, CASE WHEN kept[1] THEN b[1] END AS fb FROM ev_fit)"
    body = f"""SELECT {', '.join('co.' + k for k in by)}, {cols} FROM co JOIN sz USING ({keys}) JOIN raw USING ({keys})
WHERE rws >= {min_rows} AND trt >= {min_treated} AND lv = 2"""
    head = f"WITH RECURSIVE {base}, {fit}, {sizes}, {coef}, {raw}"
    if dense:
        return f"{head}, res AS ({body}) SELECT CAST(h AS INTEGER) AS hora_int, b, se, lo, hi, p, pct, n FROM range(24) t(h) LEFT JOIN res ON hora_int = h"
    return f"{head} {body}"


def hourly_out(df, by, bands=True):
    cols = ["b", "se", *(["lo", "hi", "p"] if bands else [])]
    return rounded(df.select(*by, *cols, "pct", "n"), *cols).withColumn("pct", F.round("pct", 4))


@query(hourly_fit_sql(VENUE_BASE, "cpl", ["hora_int"], dense=True))
def hourly_event_study(spark, sf):
    return hourly_out(venue.event_study_hourly(Venue(spark, sf).concert_panel()), ["hora_int"])


@query(hourly_fit_sql(VENUE_BASE, "fpl", ["hora_int"], dense=True))
def hourly_event_study_festival(spark, sf):
    return hourly_out(venue.event_study_hourly(Venue(spark, sf).festival_panel()), ["hora_int"])


@query(f"SELECT hora_int, pct FROM ({hourly_fit_sql(VENUE_BASE, 'cpl', ['hora_int'])}) ORDER BY pct DESC LIMIT 1")
def peak_effect_hour(spark, sf):
    return venue.peak_effect(venue.event_study_hourly(Venue(spark, sf).concert_panel())).withColumn("pct", F.round("pct", 4))


DAYTYPE = f"""{VENUE_BASE},
dt AS (SELECT *, CASE WHEN isodow(fecha) >= 6 THEN 'fds' ELSE 'hab' END AS tipo_dia FROM fpl WHERE event_d = 1
  UNION ALL SELECT c.*, k.tipo_dia FROM fpl c, (SELECT DISTINCT CASE WHEN isodow(fecha) >= 6 THEN 'fds' ELSE 'hab' END AS tipo_dia, isodow(fecha) AS d FROM fest) k
  WHERE event_d = 0 AND isodow(c.fecha) = k.d)"""


@query(hourly_fit_sql(DAYTYPE, "dt", ["tipo_dia", "hora_int"], min_rows=4))
def hourly_event_study_by_daytype(spark, sf):
    v = Venue(spark, sf)
    out = venue.by_day_kind(v.panel, venue.festival_days(v.calendar, v.holidays), v.festival_controls())
    return hourly_out(out, ["tipo_dia", "hora_int"])


SPILL = f"""{VENUE_BASE}, {DIST[len(S.HOURLY) + 2:]},
sp AS (SELECT cpl.*, dist_bin FROM cpl JOIN dist USING (codigo_estacion) WHERE dist_bin IS NOT NULL AND hora_int BETWEEN 20 AND 23)"""


@query(hourly_fit_sql(SPILL, "sp", ["dist_bin", "hora_int"]))
def spillover_bands(spark, sf):
    out = venue.spillover_by_distance(Venue(spark, sf).concert_panel(), distances(spark, sf))
    return hourly_out(out, ["dist_bin", "hora_int"])


BIGPANEL = f"""{NIGHTS}, bp AS (SELECT sh.*, 1 AS event_d FROM sh WHERE fecha IN (SELECT fecha FROM big)
  UNION ALL SELECT sh.*, 0 FROM sh WHERE fecha IN (SELECT control FROM bc5)),
both_ AS (SELECT *, 'conciertos' AS grupo FROM cpl UNION ALL SELECT *, ln(greatest(total, 1)), 'grandes' FROM bp)"""


@query(hourly_fit_sql(BIGPANEL, "both_", ["grupo", "hora_int"], min_rows=0, min_treated=3, cov="nonrobust", bands=False))
def hourly_event_study_nonrobust(spark, sf):
    v = Venue(spark, sf)
    return hourly_out(venue.concerts_vs_big_nights(v.concert_panel(), v.big_panel()), ["grupo", "hora_int"], bands=False)


TYPES = f"""{VENUE_BASE}, tp AS (SELECT *, 0 AS flag, 0 AS inter FROM cpl WHERE hora_int BETWEEN 18 AND 23
  UNION ALL SELECT *, 1, event_d FROM fpl WHERE hora_int BETWEEN 18 AND 23),
{ols_ctes('tp', ['event_d', 'flag', 'inter'], 'log_total', by=['hora_int'], absorb='codigo_estacion', name='tp')}"""


@query(f"""WITH RECURSIVE {TYPES}, sz AS (SELECT hora_int, count(*) AS rws, count(DISTINCT event_d) AS lv FROM tp GROUP BY 1)
SELECT f.hora_int, {r('f.b[1]')} AS b_conc, {r('(exp(f.b[1]) - 1) * 100', 4)} AS pct_conc, {r('f.b[1] + f.b[3]')} AS b_fdv,
  {r('(exp(f.b[1] + f.b[3]) - 1) * 100', 4)} AS pct_fdv, {r('(exp(f.b[1] + f.b[3]) - exp(f.b[1])) * 100', 4)} AS dif_pp,
  {r('f.b[3] ^ 2 / c.v[3][3]', 4)} AS f,
  (SELECT {r(p_f('w', '1', 'd'), 4)} FROM (SELECT f.b[3] ^ 2 / c.v[3][3] AS w, f.n - len(list_filter(f.kept, lambda t: t)) - ents AS d)) AS p
FROM tp_fit f JOIN (SELECT hora_int AS eh, count(DISTINCT codigo_estacion) AS ents FROM tp GROUP BY 1) ON eh = f.hora_int JOIN tp_cov c ON f.hora_int = c.hora_int JOIN sz ON sz.hora_int = f.hora_int WHERE rws >= 8 AND lv = 2 AND f.kept[1] AND f.kept[3]""")
def event_type_interaction(spark, sf):
    v = Venue(spark, sf)
    out = venue.compare_event_types(v.concert_panel(), v.festival_panel()).drop("sig")
    return rounded(out, "b_conc", "b_fdv").withColumns({c: F.round(c, 4) for c in ("pct_conc", "pct_fdv", "dif_pp", "f", "p")})


QUERIES = Q
