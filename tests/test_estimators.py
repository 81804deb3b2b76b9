"""Estimators against dense linear algebra, textbook values and planted effects."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from farebox.functions import distributions as dist
from farebox.functions.numeric import distance_bin, distance_class, stars
from farebox.functions.geo import haversine, project_tm
from farebox.operators import panels, synth
from farebox.operators.events import event_time_join, nearest_pooled, nearest_same_weekday
from farebox.operators.regression import ols_fit
from farebox.operators.spatial import distance_to_point, within_distance_of_lines
from farebox.plans import demand, holidays, kpis, openstreets, summary, suspension
from farebox.schemas import DISTANCE_CLASSES


def test_distribution_tables():
    assert dist.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert dist.t_two_sided(12.7062047, 1) == pytest.approx(0.05, abs=1e-8)
    assert dist.f_upper(2.866081402, 4, 20) == pytest.approx(0.05, abs=1e-9)
    assert dist.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert dist.t_quantile_975(5) == pytest.approx(2.570581836, abs=1e-8)


def dense(df, xs, entity=None, cov="hc3"):
    """Dummy-variable least squares with the textbook covariance formulas."""
    extra = [np.ones(len(df))] if entity is None else [(df[entity] == v).to_numpy(float) for v in sorted(df[entity].unique())]
    x = np.column_stack([df[c].to_numpy(float) for c in xs] + extra)
    y, k = df.y.to_numpy(), len(xs)
    a = np.linalg.inv(x.T @ x)
    b = a @ x.T @ y
    e = y - x @ b
    if cov == "hc3":
        h = np.einsum("ij,jk,ik->i", x, a, x)
        v = a @ (x.T * (e / (1 - h)) ** 2) @ x @ a
    elif cov == "nonrobust":
        v = a * (e @ e) / (len(df) - x.shape[1])
    else:
        scores = [x[(df[entity] == g).to_numpy()].T @ e[(df[entity] == g).to_numpy()] for g in df[entity].unique()]
        v = a @ sum(np.outer(s, s) for s in scores) @ a * len(df) / (len(df) - k)
    return b[:k], np.sqrt(np.diag(v))[:k], e @ e


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    n = 300
    df = pd.DataFrame({
        "g": rng.integers(0, 2, n), "ent": rng.integers(0, 9, n), "x1": rng.normal(size=n).round(1), "x2": rng.integers(0, 2, n),
        "x3": rng.normal(size=n), "x4": rng.normal(size=n), "x5": rng.integers(0, 3, n),
    })
    df["y"] = 1 + 0.5 * df.x1 - 0.3 * df.x2 + 0.1 * df.ent + rng.normal(size=n)
    return df


@pytest.mark.parametrize("cov", ["hc3", "nonrobust", "cluster"])
def test_fixed_effects_fit(spark, sample, cov):
    for compress in (True, False):
        m = ols_fit(spark.createDataFrame(sample), "y", ["x1", "x2"], absorb="ent", cov=cov, compress=compress)
        got = m.coefficients().toPandas()
        b, se, rss = dense(sample, ["x1", "x2"], "ent", cov)
        np.testing.assert_allclose(got.b, b, atol=1e-11)
        np.testing.assert_allclose(got.se, se, atol=1e-11)
        assert m.frame.first().rss == pytest.approx(rss, rel=1e-10)
        assert got.df_resid[0] == 300 - 2 - 9


def test_grouped_wide_fit_and_tests(spark, sample):
    xs = ["x1", "x2", "x3", "x4", "x5"]
    m = ols_fit(spark.createDataFrame(sample), "y", xs, by=["g"], cov="hc3")
    got = m.coefficients().toPandas().sort_values(["g", "term"])
    for g, part in sample.groupby("g"):
        b, se, _ = dense(part, xs)
        mine = got[got.g == g]
        np.testing.assert_allclose(mine.b, b, atol=1e-10)
        np.testing.assert_allclose(mine.se, se, atol=1e-10)
    classical = ols_fit(spark.createDataFrame(sample), "y", xs)
    f = classical.nested_f(["x3", "x4"]).first()
    full, small = dense(sample, xs, cov="nonrobust")[2], dense(sample, ["x1", "x2", "x5"], cov="nonrobust")[2]
    assert f.f == pytest.approx((small - full) / 2 / (full / 294), rel=1e-9) and (f.q, f.df_resid) == (2, 294)
    # One zero restriction: F is the squared t statistic, with the same p value.
    t = classical.coefficients(["x3"]).first()
    w = classical.wald({"x3": {"x3": 1.0}}).first()
    assert w.f == pytest.approx(t.stat**2) and w.p == pytest.approx(t.p)
    r2 = lambda j: 1 - dense(sample.assign(y=sample[j]), [c for c in xs if c != j], cov="nonrobust")[2] / sample[j].var(ddof=0) / 300
    vif = {r.term: r.vif for r in classical.vif().collect()}
    assert vif["x3"] == pytest.approx(1 / (1 - r2("x3")), rel=1e-9)
    b, _, _ = dense(sample, xs)
    assert classical.intercepts().first().intercept == pytest.approx(sample.y.mean() - sample[xs].mean() @ b)


def test_collinear_constant_and_missing(spark, sample):
    df = sample.assign(twice=2 * sample.x1, const=0.1, miss=sample.x2.astype(float))
    df.loc[:9, "miss"] = None
    m = ols_fit(spark.createDataFrame(df), "y", ["x1", "twice", "const", "miss"], cov="hc3")
    got = {r.term: r for r in m.coefficients().collect()}
    assert got["twice"].b is None and got["const"].b is None and got["x1"].n == 290
    b, se, _ = dense(df.iloc[10:], ["x1", "miss"])
    assert (got["x1"].b, got["x1"].se) == (pytest.approx(b[0]), pytest.approx(se[0]))


def test_badly_scaled_price_is_stable(spark):
    rng = np.random.default_rng(0)
    price = np.log(15800 + 25 * np.arange(12))
    df = pd.DataFrame({"p": price, "trend": np.arange(1, 13), "y": 18 + 3 * price + 0.01 * rng.normal(size=12)})
    got = ols_fit(spark.createDataFrame(df), "y", ["p", "trend"], cov="hc3").coefficients().toPandas()
    shifted = df.assign(p=df.p - df.p.mean())
    b, se, _ = dense(shifted, ["p", "trend"])
    np.testing.assert_allclose(got.b, b, rtol=1e-6)
    np.testing.assert_allclose(got.se, se, rtol=1e-6)


def test_full_leverage_gives_no_error(spark):
    df = pd.DataFrame({"e": [1, 1, 1, 2, 3, 3], "x": [0, 0, 1, 0, 0, 0], "y": [1.0, 2.0, 4.0, 9.0, 3.0, 5.0]})
    row = ols_fit(spark.createDataFrame(df), "y", ["x"], absorb="e", cov="hc3").coefficients().first()
    assert row.b == pytest.approx(2.5) and row.se is None  # the only treated row has leverage one
    df.loc[len(df)] = [1, 1, 5.0]
    row = ols_fit(spark.createDataFrame(df), "y", ["x"], absorb="e", cov="hc3").coefficients().first()
    assert row.se is not None


def test_holiday_effect_is_recovered(spark):
    days = [dt.date(2025, 1, 1) + dt.timedelta(i) for i in range(365)]
    off = {dt.date(2025, 3, 24), dt.date(2025, 5, 1), dt.date(2025, 6, 30), dt.date(2025, 8, 7), dt.date(2025, 10, 13)}
    rng = np.random.default_rng(5)
    total = [math.exp(10 + 0.1 * d.weekday() - (1.0 if d in off else 0) + 0.001 * rng.normal()) for d in days]
    daily = spark.createDataFrame(pd.DataFrame({"fecha": days, "total": total}))
    hol = spark.createDataFrame([(d, "x") for d in sorted(off)] + [(dt.date(2025, 6, 30), "again")], "date date, local_name string")
    res = {r.k: r for r in holidays.event_study_daily(daily, hol).collect()}
    assert res[0].b == pytest.approx(-1, abs=0.01) and res[0].sig == "***" and res[0].lo < -1 + 0.01
    assert (res[-1].b, res[-1].lo, res[-1].p) == (0.0, 0.0, None) and abs(res[3].b) < 0.01
    assert holidays.pretrend_test(daily, hol).first().p > 0.001
    assert holidays.individual_effects(daily, hol).count() == 6


def test_overlap_counts(spark):
    days = spark.createDataFrame([(dt.date(2025, 1, d),) for d in range(1, 20)], "fecha date")
    hol = spark.createDataFrame([(dt.date(2025, 1, 5),), (dt.date(2025, 1, 8),), (dt.date(2025, 1, 8),)], "date date")
    got = {r.fecha.day: r for r in event_time_join(days, hol).collect()}
    assert (got[6].n_overlap, got[6].offsets) == (2, [-2, 1])
    assert (got[14].n_overlap, got[14].offsets, got[13].offsets) == (0, [], [5])


def brute_controls(events, days, n, barred, skip_self):
    out = set()
    for e in events:
        ok = [d for d in days if d.weekday() == e.weekday() and d not in barred and (d != e if skip_self else d not in events)]
        out |= {(e, c) for c in sorted(ok, key=lambda d: (abs((d - e).days), d))[:n]}
    return out


@pytest.mark.parametrize("skip_self", [False, True])
def test_matched_controls_against_brute_force(spark, skip_self):
    days = [dt.date(2025, 1, 1) + dt.timedelta(i) for i in range(200)]
    rng = np.random.default_rng(7)
    events = sorted(set(rng.choice(days, 12)))
    barred = sorted(set(rng.choice(days, 40)) - set(events))
    frame = lambda ds: spark.createDataFrame([(d,) for d in ds], "fecha date")
    got = nearest_same_weekday(frame(events), frame(days), 5, frame(barred), skip_self).collect()
    assert {(r.evento, r.control) for r in got} == brute_controls(events, days, 5, set(barred), skip_self)
    if not skip_self:
        pooled = {(r.dow, r.control) for r in nearest_pooled(frame(events), frame(days), 4, frame(barred)).collect()}
        want = set()
        for dow in range(7):
            evs = [e for e in events if e.weekday() == dow]
            ok = [d for d in days if d.weekday() == dow and d not in barred and d not in events]
            if evs:
                want |= {(dow, d) for d in sorted(ok, key=lambda d: (min(abs((d - e).days) for e in evs), d))[:4]}
        assert pooled == want


def simplex_reference(g, c, steps=20000):
    w = np.ones(len(c)) / len(c)
    step = 1 / np.linalg.eigvalsh(g).max()
    for _ in range(steps):
        v = np.sort(u := w - step * (g @ w - c))[::-1]
        cum = np.cumsum(v) - 1
        r = np.nonzero(v * np.arange(1, len(c) + 1) > cum)[0][-1]
        w = np.maximum(u - cum[r] / (r + 1), 0)
    return w


def test_simplex_weights():
    rng = np.random.default_rng(1)
    for s in range(12):
        j = int(rng.integers(2, 12))
        x = 1 + 0.3 * rng.normal(size=(60, j))
        if s % 4 == 0:
            x[:, 1] = x[:, 0]
        y = x @ rng.dirichlet(np.ones(j) * 0.3) + 0.1 * rng.normal(size=60)
        g, c = x.T @ x, x.T @ y
        w, v = synth.simplex_weights(g, c), simplex_reference(g, c)
        assert w.sum() == pytest.approx(1) and (w >= 0).all()
        assert w @ g @ w - 2 * c @ w <= v @ g @ v - 2 * c @ v + 1e-3


def test_synthetic_control_finds_planted_loss(spark):
    rng = np.random.default_rng(2)
    days = [dt.date(2025, 1, 1) + dt.timedelta(i) for i in range(120)]
    base = {u: 1000 * (1 + 0.3 * rng.normal(size=120)) + 5000 for u in range(5)}
    base[9] = 0.6 * base[0] + 0.4 * base[1]
    rows = [(u, d, float(v[i]) * (0.1 if u == 9 and i >= 100 else 1.0)) for u, v in base.items() for i, d in enumerate(days)]
    panel = spark.createDataFrame(rows, "codigo_linea long, fecha date, total double").withColumn("dow", F.lit(0))
    d = suspension.Design("codigo_linea", "fecha", "dow", 9, str(days[100]), str(days[119]), "2100-01-01")
    norm = suspension.normalised(panel, d)
    w = suspension.weights(norm, d, all_units=True).cache()
    mine = {r.donor: r.w for r in w.where("treated = 9").collect()}
    assert mine[0] > 0.5 and mine[1] > 0.3 and sum(mine.values()) == pytest.approx(1)
    loss = suspension.lost(norm, w, panel, d, F.lit(0)).where("treated = 9").first()
    assert loss.pct_lost == pytest.approx(90, abs=5) and loss.n_dias == 20
    test = suspension.randomisation_test(norm, w, d).first()
    assert test.ratio > 5 and (test.n_placebos == 0 or test.p_value == 0)


def test_geography(spark):
    pts = spark.createDataFrame([(1, -74.0785, 4.6476), (2, -74.0785, 4.6521), (3, -74.07750791666666, 4.596200416666666)],
                                "codigo_estacion long, lon double, lat double")
    xy = {r.codigo_estacion: r for r in project_tm(pts).collect()}
    assert (xy[3].x, xy[3].y) == (pytest.approx(1e6, abs=1e-6), pytest.approx(1e6, abs=1e-6))  # false origin
    d = {r.codigo_estacion: r for r in distance_to_point(pts).collect()}
    assert d[1].dist_m == pytest.approx(0, abs=1e-6) and d[1].grupo == "tratada_primaria"
    far = pts.where("codigo_estacion = 2").select(haversine(F.lit(-74.0785), F.lit(4.6476), "lon", "lat")).first()[0]
    assert d[2].dist_m == pytest.approx(far, rel=0.01)
    edges = spark.createDataFrame([(0.0,), (500.0,), (500.1,), (3000.0,), (3001.0,)], "m double")
    got = [tuple(r) for r in edges.select(distance_class("m", DISTANCE_CLASSES), distance_bin("m", [0, 500, 1500, 3000])).collect()]
    assert got == [("tratada_primaria", None), ("tratada_primaria", 1), ("tratada_secundaria", 2), ("tratada_terciaria", 3), ("control", None)]


def test_near_lines_against_brute_force(spark):
    rng = np.random.default_rng(4)
    pts = [(i, float(-74.2 + 0.2 * rng.random()), float(4.5 + 0.2 * rng.random())) for i in range(150)]
    line = [(float(-74.2 + 0.2 * rng.random()), float(4.5 + 0.2 * rng.random())) for _ in range(6)]
    points = spark.createDataFrame(pts, "codigo_estacion long, lon double, lat double")
    routes = spark.createDataFrame([(0, 0, [{"lon": a, "lat": b} for a, b in line]), (1, 0, [{"lon": -74.1, "lat": 4.6}])],
                                   "route_id int, part_id int, points array<struct<lon:double,lat:double>>")
    xy = {r.codigo_estacion: np.array([r.x, r.y]) for r in project_tm(points).collect()}
    verts = [np.array([r.x, r.y]) for r in project_tm(spark.createDataFrame(line, "lon double, lat double")).collect()]

    def distance(p):
        best = math.inf
        for a, b in zip(verts, verts[1:]):
            t = np.clip((p - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)
            best = min(best, float(np.linalg.norm(p - a - t * (b - a))))
        return best

    for metres in (300.0, 900.0):
        got = {r.codigo_estacion: r for r in within_distance_of_lines(points, routes, metres).collect()}
        for i, p in xy.items():
            want = distance(p)
            assert got[i].cerca == int(want <= metres)
            if want <= metres:
                assert got[i].dist_m == pytest.approx(want, abs=1e-6)


def test_parallel_trend_p_value(spark):
    rng = np.random.default_rng(6)
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(7 * 60)]
    rows = [(s, d, float(math.exp(5 + (s % 2) + 0.1 * rng.normal()))) for s in range(4) for d in days]
    facts = spark.createDataFrame(rows, "codigo_estacion long, fecha date, total double")
    near = spark.createDataFrame([(s, s % 2) for s in range(4)], "codigo_estacion long, cerca int")
    out = openstreets.parallel_trends(openstreets.daily_panel(facts, near)).first()
    assert out.n_semanas == 60 and out.p == pytest.approx(dist.t_two_sided(out.t, 58))
    assert abs(out.did_naive) < 0.1


def test_effect_table_and_stars(spark):
    coefs = spark.createDataFrame([(-1.0, -1.2, -0.8, 0.0001), (0.05, -0.1, 0.2, 0.4)], "b double, lo double, hi double, p double")
    table = summary.effect_table([summary.effect_rows(coefs, "e", "c", "m")]).orderBy("efecto_pct").collect()
    assert [(r.sig, r.marca, r.escala) for r in table] == [(True, "***", "grande"), (False, "", "pequeño")]
    p = spark.createDataFrame([(0.009,), (0.04,), (0.09,), (0.1,)], "p double")
    assert [r[0] for r in p.select(stars("p", "ns")).collect()] == ["***", "**", "*", "ns"]


def test_kpis_need_data(spark):
    empty = spark.createDataFrame([], "fecha date, total long")
    with pytest.raises(Exception, match="sin validaciones"):
        kpis.mean_daily(empty).collect()


def test_demand_model(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(int(m), int(d), int(h), 0, 0, "ABT"[i % 3], 4.6, -74.1, float(10 * h + rng.integers(0, 3)))
            for i, (m, d, h) in enumerate(zip(rng.integers(1, 13, 300), rng.integers(1, 28, 300), rng.integers(0, 24, 300)))]
    cols = "mes int, dia int, hora int, minuto int, segundo int, letra_zona string, lat double, lon double, Entradas double"
    training = demand.demand_features(spark.createDataFrame(rows, cols))
    scaler = demand.fit_scaler(training)
    model = demand.fit_demand_model(training, scaler, trees=10)
    assert demand.model_metrics(model, training, scaler)["r2"] > 0.9
    model.write().save(str(tmp_path / "rf"))
    model = type(model).load(str(tmp_path / "rf"))
    scen = spark.createDataFrame([(7, "a"), (20, "b"), (8, "z")], "hora int, letra_zona string")
    out = {r.hora: r for r in demand.score_scenarios(scen, model, scaler).collect()}
    assert out[7].exito and 30 < out[7].prediccion_entradas < 120 < out[20].prediccion_entradas
    assert not out[8].exito and out[8].prediccion_entradas is None and "Zona 'Z' no válida" in out[8].mensaje
    assert demand.score_scenarios(scen, model, None).count() == 3
    # The forest as a table of nodes gives the same.
    nodes = demand.forest_nodes(model)
    assert nodes.select("tree").distinct().count() == 10 and nodes.columns == [c.split()[0] for c in demand.NODES.split(", ")]
    grid = spark.createDataFrame([(h, z) for h in range(24) for z in "abtz"], "hora int, letra_zona string")
    for kind in (scaler, None):
        by_model, by_nodes = (sorted(map(str, demand.score_scenarios(grid, m, kind).collect())) for m in (model, nodes))
        assert by_model == by_nodes
    with pytest.raises(Exception, match="deeper than stated"):
        demand.walk_forest(grid.select(F.array(*[F.lit(0.5)] * 19).alias("x")), nodes, "x", "p", depth=2).collect()


def test_donors_beyond_the_pool_enter(spark):
    """Two far units on opposite sides fit best; a pool of the nearest alone must not hide them."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=30)
    series = {0: base, 1: base + 5, 2: base - 5} | {k: base + rng.normal(size=30) for k in range(3, 12)}
    rows = [(k, t, float(v)) for k, s in series.items() for t, v in enumerate(s)]
    panel = spark.createDataFrame(rows, "u long, t long, y double")
    for treated in ([0], None):
        whole = {(r.treated, r.donor): r.w for r in synth.synthetic_control_weights(panel, "u", "t", "y", treated).collect()}
        for donors in (1, 3):
            got = {(r.treated, r.donor): r.w for r in synth.synthetic_control_weights(panel, "u", "t", "y", treated, donors).collect()}
            assert got.keys() == whole.keys() and all(abs(got[k] - whole[k]) < 1e-6 for k in whole)
        assert abs(whole[0, 1] - 0.5) < 1e-6 and abs(whole[0, 2] - 0.5) < 1e-6


@pytest.mark.parametrize("ranked", [1, 3, 4096])
def test_medians_by_counting_equal_the_definition(spark, ranked):
    rng = np.random.default_rng(ranked)
    rows = [(int(k) if k < 5 else None, float(v)) for k, v in zip(rng.integers(0, 6, 400), np.round(rng.exponential(5, 400) ** 3, 1))]
    rows += [(9, None), (10, 7.0), (11, -1.0), (11, 4.0), (12, 3.0), (12, 3.0), (12, 1e9)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {r.k: r.m for r in panels.median_by(df, "k", "v", "m", ranked).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        values = [v for j, v in rows if j == k and v is not None]
        want[k] = float(np.median(values)) if values else None
    assert got == pytest.approx(want)


def test_median_of_ten_million_different_values(spark):
    """One group whose values no task may hold at once: at most 4,096 of them are ranked."""
    n = 10_000_000
    df = spark.range(n).selectExpr("1 AS k", "CAST((id * 7919) % 10000000 AS DOUBLE) AS v")
    assert panels.median_by(df, "k", "v", "m").first().m == (n - 1) / 2


@pytest.mark.parametrize("series", [None, ["s"], ["s", "z"]])
def test_differences_over_ranges(spark, series):
    rng = np.random.default_rng(3)
    rows = [(int(s) if s else None, "z", t, float(rng.normal())) for t in range(120) for s in ([0, 1, 2] if series else [1])]
    df = spark.createDataFrame(rows, "s long, z string, t long, y double").repartition(5)
    got = {(r.s, r.t): r.d_y for r in panels.first_difference(df, "t", ["y"], series).collect()}
    value = {(s, t): y for s, _, t, y in rows}
    assert got == pytest.approx({(s, t): y - value[s, t - 1] for (s, t), y in value.items() if t})
