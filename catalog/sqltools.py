"""SQL text for least squares, so estimates can be checked without any matrix library.

Normal equations are collected as a list of lists and solved by Gauss-Jordan steps in a
recursive query.
"""

from __future__ import annotations


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def ols_ctes(source: str, xs: list[str], y: str, by: list[str] = (), absorb: str | None = None,
             cov: str = "hc3", cluster: str | None = None, name: str = "ols") -> str:
    """CTEs ending in ``<name>_fit`` (by..., n, b list, kept list) and ``<name>_cov`` (by..., v list of lists).

    ``source`` is a table without missing values. Pivots left without variation by the
    earlier ones are skipped and their term reported as not kept.
    """
    p, by = len(xs), list(by)
    keys = by + ([absorb] if absorb else [])
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    bys = "".join(f"{k}, " for k in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    carried = sorted({*keys, *([cluster] if cluster else [])})
    zs = ", ".join(f"x{i} - avg(x{i}) OVER w AS z{i}" for i in range(1, p + 1))
    sel = ", ".join(f"CAST({x} AS DOUBLE) AS x{i}" for i, x in enumerate(xs, 1))
    car = "".join(f"{k}, " for k in carried)
    rows = ", ".join(
        "[" + ", ".join([f"sum(z{i} * z{j})" for j in range(1, p + 1)] + [f"sum(z{i} * zy)"]
                        + ["1.0::DOUBLE" if i == j else "0.0::DOUBLE" for j in range(1, p + 1)]) + "]"
        for i in range(1, p + 1)
    )
    on = " AND ".join(f"a.{k} = f.{k}" for k in by) or "true"
    lever = "1.0 / ne + " + f"list_sum([list_sum([f.a[i][j] * zz[i] * zz[j] for j in range(1, {p + 1})]) for i in range(1, {p + 1})])"
    ctes = f"""
{name}_x AS (SELECT {car}{sel}, CAST({y} AS DOUBLE) AS yy FROM {source}),
{name}_z AS (SELECT {car}{zs}, yy - avg(yy) OVER w AS zy, count(*) OVER w AS ne FROM {name}_x WINDOW w AS ({part})),
{name}_g AS (SELECT {bys}count(*) AS n, [{rows}] AS m, [{', '.join(f'sum(z{i} * z{i})' for i in range(1, p + 1))}] AS d
  FROM {name}_z {group}),
{name}_j AS (
  SELECT {bys}n, d, 1 AS k, m, CAST([] AS BOOLEAN[]) AS kept FROM {name}_g
  UNION ALL
  SELECT {bys}n, d, k + 1,
    CASE WHEN d[k] <= 1e-12 OR m[k][k] <= 1e-10 * d[k] THEN m ELSE
      [[CASE WHEN i = k THEN m[k][c] / m[k][k] ELSE m[i][c] - m[i][k] * m[k][c] / m[k][k] END
        for c in range(1, {2 * p + 2})] for i in range(1, {p + 1})] END,
    list_append(kept, NOT (d[k] <= 1e-12 OR m[k][k] <= 1e-10 * d[k]))
  FROM {name}_j WHERE k <= {p}),
{name}_fit AS (
  SELECT {bys}n, kept, [CASE WHEN kept[i] THEN m[i][{p + 1}] ELSE 0.0 END for i in range(1, {p + 1})] AS b,
    [[CASE WHEN kept[i] AND kept[j] THEN m[i][{p + 1} + j] ELSE 0.0 END for j in range(1, {p + 1})]
      for i in range(1, {p + 1})] AS a
  FROM {name}_j WHERE k = {p} + 1)"""
    zz = ", ".join(f"z{i}" for i in range(1, p + 1))
    resid = f"zy - list_sum([f.b[i] * zz[i] for i in range(1, {p + 1})])"
    fby = "".join(f"f.{k}, " for k in by)
    fgroup = f"GROUP BY {', '.join(by)}" if by else ""
    ctes += f""",
{name}_e AS (SELECT {"".join(f"a.{k}, " for k in carried)}zz, {resid} AS e{f', {lever} AS h' if cov == 'hc3' else ''}
  FROM (SELECT *, [{zz}] AS zz FROM {name}_z) a JOIN {name}_fit f ON {on})"""
    if cov == "hc3":
        weight = "CASE WHEN h >= 1 - 1e-9 THEN 0.0 ELSE e * e / ((1 - h) * (1 - h)) END"
        ctes += f""",
{name}_w AS (SELECT *, {weight} AS w,
    CASE WHEN h >= 1 - 1e-9 AND list_max([abs(t) for t in zz]) > 1e-9 THEN 1 ELSE 0 END AS bad FROM {name}_e)"""
    elif cov == "cluster":
        ctes += f""",
{name}_w AS (SELECT {bys}{cluster}, [{', '.join(f'sum(zz[{i}] * e)' for i in range(1, p + 1))}] AS zz, 1.0 AS w, 0 AS bad
  FROM {name}_e GROUP BY {', '.join(by + [cluster])})"""
    elif cov == "nonrobust":
        entity = f"count(DISTINCT {absorb})" if absorb else "1"
        ctes += f""",
{name}_s AS (SELECT {bys}sum(e * e) AS rss, count(*) - {entity} AS nn FROM {name}_e {fgroup}),
{name}_cov AS (SELECT {fby}f.n, [[f.a[i][j] * s.rss / nullif(s.nn - len(list_filter(f.kept, lambda t: t)), 0)
    for j in range(1, {p + 1})] for i in range(1, {p + 1})] AS v
  FROM {name}_fit f JOIN {name}_s s ON {on.replace('a.', 's.')})"""
        return ctes
    meat = ", ".join("[" + ", ".join(f"sum(w * zz[{i}] * zz[{j}])" for j in range(1, p + 1)) + "]" for i in range(1, p + 1))
    factor = f"f.n / nullif(f.n - len(list_filter(f.kept, lambda t: t)), 0)" if cov == "cluster" else "1.0"
    prod = (
        f"[[list_sum([list_sum([f.a[i][k] * q.meat[k][l] * f.a[l][j] for l in range(1, {p + 1})]) for k in range(1, {p + 1})])"
        f" * {factor} for j in range(1, {p + 1})] for i in range(1, {p + 1})]"
    )
    if p > 6:  # two products, so the work stays cubic
        inner = f"[[list_sum([f.a[i][k] * q.meat[k][j] for k in range(1, {p + 1})]) for j in range(1, {p + 1})] for i in range(1, {p + 1})]"
        ctes += f""",
{name}_m AS (SELECT {bys}max(bad) AS bad, [{meat}] AS meat FROM {name}_w {fgroup}),
{name}_h AS (SELECT {fby}f.n, f.a, f.kept, q.bad, {inner} AS am FROM {name}_fit f JOIN {name}_m q ON {on.replace('a.', 'q.')}),
{name}_cov AS (SELECT {fby}f.n, CASE WHEN f.bad > 0 THEN NULL ELSE
    [[list_sum([f.am[i][k] * f.a[k][j] for k in range(1, {p + 1})]) * {factor} for j in range(1, {p + 1})]
     for i in range(1, {p + 1})] END AS v FROM {name}_h f)"""
        return ctes
    ctes += f""",
{name}_m AS (SELECT {bys}max(bad) AS bad, [{meat}] AS meat FROM {name}_w {fgroup}),
{name}_cov AS (SELECT {fby}f.n, CASE WHEN q.bad > 0 THEN NULL ELSE {prod} END AS v
  FROM {name}_fit f JOIN {name}_m q ON {on.replace('a.', 'q.')})"""
    return ctes


def p_z(z: str) -> str:
    """Two-sided tail of the normal law: one less the error function, by its series of positive terms."""
    x = f"(abs({z}) / sqrt(2.0))"
    term = f"exp((2 * j + 1) * ln({x}) - lgamma(j + 1.5) - {x} * {x})"
    return f"CASE WHEN {z} = 0 THEN 1.0 WHEN abs({z}) > 9 THEN 0.0 ELSE greatest(0.0, 1 - list_sum([{term} for j in range(0, 200)])) END"


def p_f(f: str, q: str, df: str) -> str:
    """Upper tail of the F law: the incomplete beta function, from the end where its series is short."""
    half, less = f"(({df}) / 2.0)", f"(({q}) / 2.0)"

    def series(a: str, b: str, u: str, v: str) -> str:
        # I_u(a, b) = u^a v^b / (a B(a, b)) * sum of (a + b)_j / (a + 1)_j u^j
        log = f"{a} * ln({u}) + {b} * ln({v}) + lgamma({a} + {b} + j) - lgamma({a} + 1 + j) - lgamma({b}) + j * ln({u})"
        return f"list_sum([exp({log}) for j in range(0, 400)])"

    top = f"(({q}) * ({f}))"
    u, v = f"({df}) / (({df}) + {top})", f"{top} / (({df}) + {top})"
    return (
        f"CASE WHEN ({df}) <= 0 OR ({f}) IS NULL THEN NULL WHEN ({f}) <= 0 THEN 1.0 WHEN {top} >= ({df}) THEN {series(half, less, u, v)} "
        f"WHEN {top} > 225 THEN 0.0 ELSE greatest(0.0, 1 - {series(less, half, v, u)}) END"
    )


def p_t(t: str, df: str) -> str:
    """Two-sided tail of the t law."""
    return p_f(f"({t}) * ({t})", "1", df)


def stars_sql(p: str, none: str) -> str:
    return f"CASE WHEN {p} < 0.01 THEN '***' WHEN {p} < 0.05 THEN '**' WHEN {p} < 0.1 THEN '*' ELSE '{none}' END"


def coef_select(name: str, i: int, by: list[str] = (), extra: str = "", critical: float = 1.959963984540054, df: str | None = None, digits: int = 6) -> str:
    """b, se, lo, hi and p of term ``i`` (from 1), rounded; null where the term was not kept.

    p follows the normal law, or the t law with n less the kept terms less ``df`` degrees of freedom.
    """
    stat = f"f.b[{i}] / sqrt(c.v[{i}][{i}])"
    tail = p_z("s") if df is None else p_t("s", "d")
    free = "NULL" if df is None else f"f.n - len(list_filter(f.kept, lambda t: t)) - {df}"
    p = f"CASE WHEN f.kept[{i}] AND c.v[{i}][{i}] > 0 THEN (SELECT {r(tail, digits)} FROM (SELECT {stat} AS s, {free} AS d)) END"
    on = " AND ".join(f"f.{k} = c.{k}" for k in by) or "true"
    keys = "".join(f"f.{k}, " for k in by)
    return f"""SELECT {keys}{extra}CASE WHEN f.kept[{i}] THEN {r(f'f.b[{i}]', digits)} END AS b,
  CASE WHEN f.kept[{i}] THEN {r(f'sqrt(c.v[{i}][{i}])', digits)} END AS se,
  CASE WHEN f.kept[{i}] THEN {r(f'f.b[{i}] - {critical} * sqrt(c.v[{i}][{i}])', digits)} END AS lo,
  CASE WHEN f.kept[{i}] THEN {r(f'f.b[{i}] + {critical} * sqrt(c.v[{i}][{i}])', digits)} END AS hi, {p} AS p, f.n
FROM {name}_fit f JOIN {name}_cov c ON {on}"""
