"""Synthetic control, effect summary and demand model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import standins as S
from catalog import studies
from catalog.panels import PRICE, price_frame, rounded, weather_panel
from catalog.sqltools import coef_select, ols_ctes, r, stars_sql
from catalog.studies import Venue, day_and_holidays
from farebox.operators import synth
from farebox.operators.panels import pivot_wide
from farebox.plans import demand, fuel, holidays as hol, openstreets, summary, suspension, venue
from farebox.plans import weather as weather_plan
from farebox.session import literal_table, materialize

DESIGN = suspension.Design(
    unit="codigo_linea", t="mes", season="season", treated=4, start=S.SUSPENSION[0], end=S.SUSPENSION[1], last=S.FAR_FUTURE,
)
START, END = (f"DATE '{d}'" for d in S.SUSPENSION)
FIXED = [(4, 0, 0.5), (4, 1, 0.3), (4, 5, 0.2)]
Q = {}


def query(sql=None):
    def add(fn):
        Q[fn.__name__] = (fn, sql)
        return fn
    return add


NORM = f"""{S.DAILY}, {S.UNIT_MONTH},
sm AS (SELECT codigo_linea, season, avg(total) AS dow_mean FROM unit_month WHERE mes < {START} GROUP BY 1, 2),
norm AS (SELECT u.*, dow_mean, total / dow_mean AS norm FROM unit_month u LEFT JOIN sm USING (codigo_linea, season))"""
GAPS = f"""{NORM}, fw AS (SELECT * FROM (VALUES {', '.join(map(str, FIXED))}) t(treated, donor, w)),
sy AS (SELECT treated, mes, sum(w * norm) AS synth FROM norm JOIN fw ON donor = codigo_linea GROUP BY 1, 2),
gaps AS (SELECT treated, mes, n.norm AS actual, synth, n.norm - synth AS gap FROM norm n JOIN sy USING (mes) WHERE codigo_linea = treated)"""


def norm(spark, sf):
    return suspension.normalised(S.unit_month(spark, sf), DESIGN)


def fixed_gaps(spark, sf):
    w = literal_table(spark, FIXED, "treated long, donor long, w double")
    return suspension.gaps(norm(spark, sf), w, DESIGN)


@query(f"WITH {NORM} SELECT codigo_linea, mes, {r('dow_mean')} AS dow_mean, {r('norm')} AS norm FROM norm")
def unit_normalised(spark, sf):
    return rounded(norm(spark, sf).select("codigo_linea", "mes", "dow_mean", "norm"), "dow_mean", "norm")


_lines = ", ".join(f"max(norm) FILTER (codigo_linea = {i}) AS v{i}" for i in range(6))


@query(f"WITH {NORM}, p AS (SELECT mes, {_lines} FROM norm GROUP BY 1) SELECT mes, "
       + ", ".join(f"{r(f'v{i}')} AS \"{i}\"" for i in range(6)) + " FROM p")
def unit_wide(spark, sf):
    wide = pivot_wide(norm(spark, sf), "mes", "codigo_linea", "norm", list(range(6)))
    return rounded(wide, *[str(i) for i in range(6)])


@query(f"WITH {GAPS} SELECT treated, mes, {r('actual')} AS actual, {r('synth')} AS synth, {r('gap')} AS gap FROM gaps")
def synth_gap_fixed(spark, sf):
    return rounded(fixed_gaps(spark, sf), "actual", "synth", "gap")


@query(f"""WITH {GAPS} SELECT treated, {r('sqrt(avg(gap * gap))')} AS rmspe, {r('sqrt(avg(gap * gap)) / avg(actual) * 100')} AS rmspe_pct,
{r('1 - var_pop(gap) / var_pop(actual)')} AS r2 FROM gaps WHERE mes < {START} GROUP BY 1""")
def synth_fit(spark, sf):
    return rounded(synth.synth_fit_stats(fixed_gaps(spark, sf), DESIGN.before), "rmspe", "rmspe_pct", "r2")


# Equal donor weights for every unit give a test table that SQL can follow exactly.
EVEN = f"""{NORM}, ew AS (SELECT a.codigo_linea AS treated, a.mes, a.norm AS actual, avg(b.norm) AS synth
  FROM norm a JOIN norm b ON a.mes = b.mes AND a.codigo_linea <> b.codigo_linea GROUP BY 1, 2, 3),
rt AS (SELECT treated, sqrt(avg((actual - synth) ^ 2) FILTER (mes < {START})) AS pre,
  sqrt(avg((actual - synth) ^ 2) FILTER (mes BETWEEN {START} AND {END})) AS post FROM ew GROUP BY 1)"""


def even_weights(spark):
    rows = [(a, b, 0.2) for a in range(6) for b in range(6) if a != b]
    return literal_table(spark, rows, "treated long, donor long, w double")


@query(f"WITH {EVEN} SELECT treated, {r('pre')} AS rmspe_pre, {r('post')} AS rmspe_post, {r('post / pre')} AS ratio FROM rt")
def rmspe_ratio(spark, sf):
    g = suspension.gaps(norm(spark, sf), even_weights(spark), DESIGN)
    return rounded(synth.rmspe_ratios(g, DESIGN.before, DESIGN.during), "rmspe_pre", "rmspe_post", "ratio")


@query(f"""WITH {EVEN}, t AS (SELECT pre, post / pre AS ratio FROM rt WHERE treated = 4)
SELECT {r('max(t.ratio)')} AS ratio, count(*) AS n_placebos, {r('avg(CASE WHEN rt.post / rt.pre >= t.ratio THEN 1.0 ELSE 0.0 END)')} AS p_value
FROM rt, t WHERE treated <> 4 AND rt.pre <= 2 * t.pre""")
def placebo_rank(spark, sf):
    return rounded(suspension.randomisation_test(norm(spark, sf), even_weights(spark), DESIGN), "ratio", "p_value")


@query(f"""WITH {GAPS}, pm AS (SELECT avg(total) AS m FROM unit_month WHERE codigo_linea = 4 AND mes < {START}),
l AS (SELECT g.treated, -g.gap * coalesce(dow_mean, 1) AS lost FROM gaps g
  LEFT JOIN sm ON sm.codigo_linea = g.treated AND sm.season = month(g.mes) WHERE mes BETWEEN {START} AND {END})
SELECT treated, {r('sum(lost)', 4)} AS total_lost, {r('avg(lost)', 4)} AS daily_lost, count(*) AS n_dias, {r('max(m)', 4)} AS pre_mean,
  {r('sum(lost) / (max(m) * count(*)) * 100')} AS pct_lost FROM l, pm GROUP BY 1""")
def lost_demand(spark, sf):
    panel = S.unit_month(spark, sf)
    w = literal_table(spark, FIXED, "treated long, donor long, w double")
    out = suspension.lost(norm(spark, sf), w, panel, DESIGN, F.month("mes"))
    return rounded(out, "total_lost", "daily_lost", "pre_mean", digits=4).withColumn("pct_lost", F.round("pct_lost", 6))


@query(f"""WITH {S.DAILY}, {S.UNIT_MONTH}, p AS (SELECT codigo_linea, avg(total) FILTER (mes < {START}) AS a,
  avg(total) FILTER (mes BETWEEN {START} AND {END}) AS b, count(*) FILTER (mes BETWEEN {START} AND {END}) AS n FROM unit_month GROUP BY 1)
SELECT codigo_linea, {r('a', 4)} AS pre_mean, {r('b', 4)} AS post_mean, n AS n_dias, {r('(1 - b / a) * 100')} AS reduccion_pct FROM p""")
def pre_post(spark, sf):
    out = synth.pre_post_means(S.unit_month(spark, sf), DESIGN.before, DESIGN.during, "codigo_linea", "total")
    return rounded(out, "pre_mean", "post_mean", digits=4).withColumn("reduccion_pct", F.round("reduccion_pct", 6))


@query(f"WITH {S.DAILY}, {S.UNIT_MONTH} SELECT mes, {r('avg(total)', 4)} AS sys_mean FROM unit_month WHERE codigo_linea <> 4 GROUP BY 1")
def other_units_mean(spark, sf):
    return rounded(synth.other_units_mean(S.unit_month(spark, sf), 4, "codigo_linea", "mes", "total"), "sys_mean", digits=4)


GRAM = f"""{NORM}, g AS (SELECT a.codigo_linea AS i, b.codigo_linea AS j, avg(a.norm * b.norm) AS v, count(*) AS n
  FROM norm a JOIN norm b USING (mes) WHERE mes < {START} GROUP BY 1, 2)"""


@query(f"WITH {GRAM} SELECT i, j, {r('v')} AS v, n FROM g")
def unit_gram(spark, sf):
    return rounded(synth.gram_cells(norm(spark, sf).where(DESIGN.before), "codigo_linea", "mes", "norm"), "v")


# The best weights over the simplex solve the equations of some support with non-negative numbers: SQL
# tries all 31 supports of the five donors and takes the smallest loss.
_in = "(mask // CAST(pow(2, {0} - 1) AS BIGINT)) % 2 = 1".format
WEIGHTS = f"""WITH RECURSIVE {GRAM},
p AS (SELECT t.i AS treated, list(d.j ORDER BY d.j) AS ds, list(d.v ORDER BY d.j) AS cc FROM (SELECT DISTINCT i FROM g) t
  JOIN g d ON d.i = t.i AND d.j <> t.i GROUP BY 1),
gr AS (SELECT p.treated, g.i AS d, list(g.v ORDER BY g.j) AS gl FROM p JOIN g ON g.i <> p.treated AND g.j <> p.treated GROUP BY 1, 2),
q AS (SELECT p.*, gg FROM p JOIN (SELECT treated, list(gl ORDER BY d) AS gg FROM gr GROUP BY 1) x USING (treated)),
kkt AS (SELECT treated, ds, cc, gg, mask, 1 AS k, [[CAST(CASE
    WHEN i <= 5 AND {_in('i')} THEN CASE WHEN j = 7 THEN cc[i] WHEN j = 6 THEN 1 WHEN {_in('j')} THEN gg[i][j] ELSE 0 END
    WHEN i <= 5 THEN CASE WHEN i = j THEN 1 ELSE 0 END
    WHEN j = 7 THEN 1 WHEN j = 6 THEN 0 WHEN {_in('j')} THEN 1 ELSE 0 END AS DOUBLE) for j in range(1, 8)] for i in range(1, 7)] AS m
  FROM q, (SELECT unnest(range(1, 32)) AS mask)),
steps AS (SELECT * FROM kkt UNION ALL SELECT treated, ds, cc, gg, mask, k + 1,
    [[CASE WHEN i = k THEN m[k][c] / m[k][k] ELSE m[i][c] - m[i][k] * m[k][c] / m[k][k] END for c in range(1, 8)] for i in range(1, 7)]
  FROM steps WHERE k <= 6),
solved AS (SELECT treated, ds, cc, gg, [m[i][7] for i in range(1, 6)] AS w FROM steps WHERE k = 7),
best AS (SELECT treated, any_value(ds) AS ds, arg_min(w, list_sum([list_sum([w[i] * w[j] * gg[i][j] for j in range(1, 6)]) - 2 * w[i] * cc[i] for i in range(1, 6)])) AS w
  FROM solved WHERE list_min(w) >= -1e-9 GROUP BY 1),
cut AS (SELECT treated, ds, [CASE WHEN x < 1e-4 THEN 0.0 ELSE x END for x in w] AS w FROM best),
wts AS (SELECT treated, unnest(ds) AS donor, unnest([x / list_sum(w) for x in w]) AS w FROM cut)"""


@query(f"{WEIGHTS} SELECT treated, donor, {r('w')} AS w FROM wts WHERE treated = 4")
def synth_weights(spark, sf):
    return rounded(suspension.weights(norm(spark, sf), DESIGN), "w")


@query(f"""{WEIGHTS}, sy AS (SELECT treated, mes, sum(w * norm) AS synth FROM norm JOIN wts ON donor = codigo_linea GROUP BY 1, 2),
rt AS (SELECT treated, sqrt(avg((n.norm - synth) ^ 2) FILTER (mes < {START})) AS pre,
  sqrt(avg((n.norm - synth) ^ 2) FILTER (mes BETWEEN {START} AND {END})) AS post FROM norm n JOIN sy USING (mes) WHERE codigo_linea = treated GROUP BY 1)
SELECT treated, {r('pre')} AS rmspe_pre, {r('post')} AS rmspe_post, {r('post / pre')} AS ratio FROM rt""")
def placebo_space(spark, sf):
    n = norm(spark, sf)
    w = suspension.weights(n, DESIGN, all_units=True)
    return rounded(synth.rmspe_ratios(suspension.gaps(n, w, DESIGN), DESIGN.before, DESIGN.during), "rmspe_pre", "rmspe_post", "ratio")


def effects_sql():
    """The same estimates from the studies' SQL, with 12 digits, as one table."""
    event = (f"WITH RECURSIVE {studies.EVENT_DAYS}, {ols_ctes('off', studies.DOW_M + studies.TERMS, 'log_total')} "
             f"{studies.offset_select('ols', len(studies.DOW_M) + 1, digits=12)}")
    price = (f"WITH RECURSIVE {PRICE}, {ols_ctes('diff', ['d_log_precio'], 'd_log_val_d', name='pd')} "
             + coef_select("pd", 1, digits=12))
    concerts = studies.hourly_fit_sql(studies.VENUE_BASE, "cpl", ["hora_int"], digits=12)
    big = f"{studies.BIGPANEL}, bl AS (SELECT * FROM both_ WHERE grupo = 'grandes')"
    nights = studies.hourly_fit_sql(big, "bl", ["hora_int"], digits=12)
    sunday = studies.did_sql(studies.DPANEL, "dp", "cerca_x_sunday", studies.DOW_M, "", digits=12)
    window = studies.did_sql(studies.hpanel(6), "hw", "cerca_x_ventana", studies.HOURS, "", digits=12)
    weather = studies.weather_sql(12)

    def part(study, what, how, sql, where="true", scale=1):
        pct = ", ".join(f"(exp({c} * {scale}) - 1) * 100 AS {n}" for c, n in (("b", "e"), ("lo", "l"), ("hi", "h")))
        return f"SELECT '{study}' AS estudio, '{what}' AS choque, '{how}' AS metodo, {pct}, p FROM ({sql}) WHERE {where}"

    parts = [
        *(part("Festivos", name, "Event study", event, f"k = {k}") for k, name in HOLIDAY_ROWS),
        part("Clima", "Día lluvioso (>5 mm)", "Panel FE", weather, "modelo = 'rain_day' AND term = 'rain_day'"),
        part("Clima", "+10 mm lluvia", "Panel FE", weather, "term = 'precip_sum'", 10),
        part("Clima", "+1 °C", "Panel FE", weather, "modelo = 'precip_sum' AND term = 'temp_mean'"),
        part("Ciclovía", "DiD diario (cerca x domingo)", "DiD espacial", sunday),
        part("Ciclovía", "DiD ventana horaria", "DiD espacial", window),
        *(part("Recinto", f"Concierto h={h}", "Event study horario", concerts, f"hora_int = {h}") for h in (15, 23)),
        part("Recinto", "Noche grande h=23", "Event study horario", nights, "hora_int = 23"),
        part("Combustible", "Precio (Δlog)", "Primeras diferencias", price),
        f"SELECT 'Suspensión', 'Brecha sintética', 'Control sintético', -pct, NULL, NULL, pv FROM ({LOSS})",
    ]
    small = "e BETWEEN -20 AND 20"
    return f"""SELECT estudio, choque, metodo, {r('e', 4)} AS efecto_pct, {r('l', 4)} AS lo95_pct, {r('h', 4)} AS hi95_pct, {r('p')} AS pval,
  coalesce(p < 0.05, false) AS sig, {stars_sql('p', '')} AS marca, CASE WHEN {small} THEN 'pequeño' ELSE 'grande' END AS escala
FROM ({' UNION ALL '.join(parts)})"""


HOLIDAY_ROWS = [(0, "Día festivo (k=0)"), (1, "Día siguiente (k=+1)"), (-2, "Dos días antes (k=-2)")]
LOSS = f"""{WEIGHTS}, sy AS (SELECT treated, mes, sum(w * norm) AS synth FROM norm JOIN wts ON donor = codigo_linea GROUP BY 1, 2),
gp AS (SELECT treated, n.mes, n.norm - synth AS gap FROM norm n JOIN sy USING (mes) WHERE codigo_linea = treated),
rt AS (SELECT treated, sqrt(avg(gap ^ 2) FILTER (mes < {START})) AS pre, sqrt(avg(gap ^ 2) FILTER (mes BETWEEN {START} AND {END})) AS post FROM gp GROUP BY 1),
own AS (SELECT pre, post / pre AS ratio FROM rt WHERE treated = 4),
pm AS (SELECT avg(total) AS m FROM unit_month WHERE codigo_linea = 4 AND mes < {START}),
lo AS (SELECT sum(-gap * coalesce(dow_mean, 1)) AS lost, count(*) AS n FROM gp LEFT JOIN sm ON sm.codigo_linea = 4 AND sm.season = month(gp.mes)
  WHERE treated = 4 AND mes BETWEEN {START} AND {END})
SELECT lost / (m * n) * 100 AS pct, (SELECT avg(CASE WHEN rt.post / rt.pre >= own.ratio THEN 1.0 ELSE 0.0 END) FROM rt, own WHERE treated <> 4 AND rt.pre <= 2 * own.pre) AS pv
FROM lo, pm"""


@query(effects_sql())
def effect_table(spark, sf):
    daily, days = day_and_holidays(spark, sf)
    d, v, h = S.daily(spark, sf), Venue(spark, sf), S.hourly(spark, sf)
    event = materialize(hol.event_study_daily(daily, days))
    weather = materialize(weather_plan.weather_effect(weather_panel(spark, sf)))
    concerts = materialize(venue.event_study_hourly(v.concert_panel()))
    nights = venue.event_study_hourly(v.big_panel())
    n = norm(spark, sf)
    w = materialize(suspension.weights(n, DESIGN, all_units=True))
    loss = suspension.lost(n, w, S.unit_month(spark, sf), DESIGN, F.month("mes")).where(F.col("treated") == DESIGN.treated)
    row = summary.effect_rows
    table = summary.effect_table([
        *(row(event.where(F.col("k") == k), "Festivos", name, "Event study") for k, name in HOLIDAY_ROWS),
        row(weather.where("modelo = 'rain_day' AND term = 'rain_day'"), "Clima", "Día lluvioso (>5 mm)", "Panel FE"),
        row(weather.where("term = 'precip_sum'"), "Clima", "+10 mm lluvia", "Panel FE", scale=10),
        row(weather.where("modelo = 'precip_sum' AND term = 'temp_mean'"), "Clima", "+1 °C", "Panel FE"),
        row(openstreets.did_two_way(d, S.near(d)), "Ciclovía", "DiD diario (cerca x domingo)", "DiD espacial"),
        row(openstreets.did_window(h, S.near(h)), "Ciclovía", "DiD ventana horaria", "DiD espacial"),
        *(row(concerts.where(F.col("hora_int") == k), "Recinto", f"Concierto h={k}", "Event study horario") for k in (15, 23)),
        row(nights.where("hora_int = 23"), "Recinto", "Noche grande h=23", "Event study horario"),
        row(fuel.first_difference_ols(price_frame(spark, sf)), "Combustible", "Precio (Δlog)", "Primeras diferencias"),
        summary.gap_rows(loss, suspension.randomisation_test(n, w, DESIGN), "Suspensión", "Brecha sintética"),
    ])
    return table.withColumns({c: F.round(c, 4) for c in ("efecto_pct", "lo95_pct", "hi95_pct")}).withColumn("pval", F.round("pval", 6))


def scenarios(spark, sf):
    """Every event as a scenario; zone letters come from the line, two of fourteen are unknown."""
    h = S.table(spark, sf, "events")
    letters = F.array(*[F.lit(z) for z in "abcdefghjkltXY"])
    return h.select(
        "event_id", F.month("ts").alias("mes"), F.day("ts").alias("dia"), F.hour("ts").alias("hora"), F.minute("ts").alias("minuto"),
        F.second("ts").alias("segundo"), F.get(letters, (F.col("user_id") % 14).cast("int")).alias("letra_zona"),
        (F.lit(4.5) + ((F.col("user_id") * 37) % 100) / 400.0).alias("lat"),
        (F.lit(-74.2) + ((F.col("user_id") * 53) % 100) / 400.0).alias("lon"),
        F.floor("value").cast("double").alias(demand.TARGET),
    )


_ZONES = demand.ZONE_LETTERS
_EVENTS = """e AS (SELECT *, upper('abcdefghjkltXY'[(user_id % 14) + 1]) AS z, 4.5::DOUBLE + ((user_id * 37) % 100) / 400.0::DOUBLE AS lat,
  -74.2::DOUBLE + ((user_id * 53) % 100) / 400.0::DOUBLE AS lon FROM events)"""
_FEATURE_SQL = {
    "Mes": "month(ts)", "Día": "day(ts)", "Hora": "hour(ts)", "Minuto": "minute(ts)", "Segundo": "second(ts)",
    **{f"Letra_{z}": f"CASE WHEN z = '{z}' THEN 1.0 ELSE 0.0 END" for z in _ZONES}, "lat": "lat", "lon": "lon",
}
_known = f"z IN ({', '.join(repr(z) for z in _ZONES)})"
_message = "'Zona ''' || z || ''' no válida. Use: [" + ", ".join(f"''{z}''" for z in _ZONES) + "]'"


@query(f"WITH {_EVENTS} SELECT event_id, z AS letra_zona, {_known} AS exito, CASE WHEN {_known} THEN '' ELSE {_message} END AS mensaje, "
       + ", ".join(f'CASE WHEN {_known} THEN round(CAST({x} AS DOUBLE), 6) END AS "{c}"' for c, x in _FEATURE_SQL.items()) + " FROM e")
def demand_features(spark, sf):
    out = demand.demand_features(scenarios(spark, sf))
    return rounded(out.select("event_id", "letra_zona", "exito", "mensaje", *demand.FEATURES), *demand.FEATURES)


_SCALED = {**_FEATURE_SQL, demand.TARGET: "floor(value)"}


def _scaled_sql(c):
    low, high = f'min("{c}") OVER ()', f'max("{c}") OVER ()'
    return f'round(CASE WHEN {high} > {low} THEN ("{c}" - {low}) / ({high} - {low}) ELSE "{c}" - {low} END, 6) + 0.0 AS "{c}"'


@query(f"""WITH {_EVENTS}, s AS (SELECT event_id, {', '.join(f'CAST({x} AS DOUBLE) AS "{c}"' for c, x in _SCALED.items())} FROM e WHERE {_known})
SELECT event_id, {', '.join(map(_scaled_sql, _SCALED))} FROM s""")
def demand_scaled(spark, sf):
    feats = demand.demand_features(scenarios(spark, sf)).where("exito")
    cols = [*demand.FEATURES, demand.TARGET]
    out = demand.minmax_scale(feats, demand.fit_scaler(feats), cols)
    return rounded(out.select("event_id", *cols), *cols)


@query()
def demand_scores(spark, sf):
    rows = scenarios(spark, sf)
    training = demand.demand_features(rows).where("exito")
    scaler = materialize(demand.fit_scaler(training))
    model = demand.fit_demand_model(training, scaler)
    return demand.score_scenarios(rows.drop(demand.TARGET), model, scaler).select(
        "event_id", "prediccion_normalizada", "prediccion_entradas", "modelo_utilizado", "exito", "mensaje"
    )


# A forest of complete trees by a rule; a fitted one has the same table (demand.forest_nodes).
def _node(tree, node):
    if node < 7:
        return tree, node, (tree * 5 + node * 3) % len(demand.FEATURES), ((tree * 7 + node * 11) % 19 + 1) / 20, 2 * node + 1, 2 * node + 2, 0.0
    return tree, node, -1, 0.0, -1, -1, ((tree * 13 + node * 17) % 23) / 23


FOREST = [_node(tree, node) for tree in range(8) for node in range(15)]


def _unrounded(c):
    low, high = f'min("{c}") OVER ()', f'max("{c}") OVER ()'
    return f'CASE WHEN {high} > {low} THEN ("{c}" - {low}) / ({high} - {low}) ELSE "{c}" - {low} END'


@query(f"""WITH RECURSIVE {_EVENTS}, s AS (SELECT event_id, {', '.join(f'CAST({x} AS DOUBLE) AS "{c}"' for c, x in _SCALED.items())} FROM e WHERE {_known}),
x AS (SELECT event_id, [{', '.join(map(_unrounded, demand.FEATURES))}] AS x, min("{demand.TARGET}") OVER () AS lo, max("{demand.TARGET}") OVER () AS hi FROM s),
nodes(tree, node, feature, threshold, low, high, value) AS (VALUES {', '.join(f'({t}, {n}, {f}, {h}::DOUBLE, {a}, {b}, {v!r}::DOUBLE)' for t, n, f, h, a, b, v in FOREST)}),
walk AS (
  SELECT event_id, x, tree, 0 AS node FROM x, (SELECT DISTINCT tree FROM nodes)
  UNION ALL SELECT event_id, x, w.tree, CASE WHEN x[feature + 1] <= threshold THEN low ELSE high END
  FROM walk w JOIN nodes n ON w.tree = n.tree AND w.node = n.node WHERE feature >= 0),
pred AS (SELECT event_id, sum(value) / count(*) AS p FROM walk w JOIN nodes n ON w.tree = n.tree AND w.node = n.node WHERE feature < 0 GROUP BY 1)
SELECT e.event_id, round(p, 6) AS prediccion_normalizada, CASE WHEN p IS NOT NULL THEN CAST(greatest(round_even(p * (hi - lo) + lo, 0), 0) AS BIGINT) END AS prediccion_entradas,
  '{demand.MODEL_NAME}' AS modelo_utilizado, {_known} AS exito, CASE WHEN {_known} THEN '' ELSE {_message} END AS mensaje
FROM e LEFT JOIN x ON x.event_id = e.event_id LEFT JOIN pred ON pred.event_id = e.event_id""")
def demand_scores_by_nodes(spark, sf):
    """All scenarios through a forest that is a table of nodes."""
    rows = scenarios(spark, sf)
    scaler = materialize(demand.fit_scaler(demand.demand_features(rows).where("exito")))
    nodes = literal_table(spark, FOREST, demand.NODES)
    return demand.score_scenarios(rows.drop(demand.TARGET), nodes, scaler).select(
        "event_id", "prediccion_normalizada", "prediccion_entradas", "modelo_utilizado", "exito", "mensaje"
    )


QUERIES = Q
