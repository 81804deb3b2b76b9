"""Tail probabilities of the normal, t and F laws for a handful of test statistics.

Used on coefficient rows only (never on data rows). The regularised incomplete beta is
evaluated by the standard continued fraction.
"""

from __future__ import annotations

import math

from statistics import NormalDist

Z975 = NormalDist().inv_cdf(0.975)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _log_gamma_step(a: float, b: float) -> float:
    """log(gamma(a + b) / gamma(a)), without the cancellation of two large logarithms."""
    if a < 1e3:
        return math.lgamma(a + b) - math.lgamma(a)

    def rest(x: float) -> float:
        return 1 / (12 * x) - 1 / (360 * x**3)

    return (a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b + rest(a + b) - rest(a)


def beta_inc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta function; ``y`` is 1 - x where it is known more exactly."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, y, x)
    big, small = max(a, b), min(a, b)
    log_x = math.log(x) if x < 0.5 else math.log1p(-y)
    log_y = math.log(y) if y < 0.5 else math.log1p(-x)
    front = math.exp(_log_gamma_step(big, small) - math.lgamma(small) + a * log_x + b * log_y) / a
    tiny = 1e-300
    c, d, frac = 1.0, 0.0, 1.0
    # The fraction needs some multiples of sqrt(max(a, b)) steps.
    most = 1000 + 20 * math.isqrt(int(max(a, b)) + 1)
    for i in range(most):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / c
        c = c if abs(c) > tiny else tiny
        step = c * d
        frac *= step
        if i and abs(1.0 - step) < 4e-16:
            return front * (frac - 1.0)
    raise ArithmeticError(f"incomplete beta function of {a}, {b} at {x} did not converge")


def t_two_sided(t: float, df: float) -> float:
    if df <= 0 or math.isnan(t):
        return math.nan
    return beta_inc(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def f_upper(f: float, q: float, df: float) -> float:
    if df <= 0 or math.isnan(f):
        return math.nan
    return beta_inc(df / 2.0, q / 2.0, df / (df + q * f), q * f / (df + q * f)) if f > 0 else 1.0


def t_quantile_975(df: float) -> float:
    """Two-sided 5 % critical value, by bisection on the tail."""
    if df <= 0:
        return math.nan
    lo, hi = 0.0, 1e3
    while t_two_sided(hi, df) > 0.05:
        hi *= 10
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > 0.05 else (lo, mid)
    return (lo + hi) / 2
