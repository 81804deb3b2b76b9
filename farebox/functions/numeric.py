"""Column expressions for outcomes, effects and codes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_floor_one(col: Column | str) -> Column:
    """``ln(max(x, 1))``, the outcome of the event studies."""
    return F.log(F.greatest(F.col(col) if isinstance(col, str) else col, F.lit(1)))


def percent(beta: Column | str) -> Column:
    """Per cent change of a log-point effect."""
    return (F.exp(beta) - 1) * 100


def stars(p: Column | str, otherwise: str = "") -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise(otherwise)


def recode(col: Column | str, mapping: Mapping[int, int]) -> Column:
    """Replace listed codes, keep the others."""
    col = F.col(col) if isinstance(col, str) else col
    pairs = [F.lit(v).cast("long") for kv in mapping.items() for v in kv]
    return F.coalesce(F.create_map(*pairs)[col], col)


def distance_class(metres: Column | str, classes) -> Column:
    """First class whose limit is not exceeded, else ``control``."""
    metres = F.col(metres) if isinstance(metres, str) else metres
    out = F.when(metres.isNull(), None)
    for limit, name in classes:
        out = out.when(metres <= limit, name)
    return out.otherwise("control")


def distance_bin(metres: Column | str, edges) -> Column:
    """Right-closed bin number 1, 2, ...; null at zero distance and beyond the last edge."""
    metres = F.col(metres) if isinstance(metres, str) else metres
    out = None
    for i in range(1, len(edges)):
        cond = (metres > edges[i - 1]) & (metres <= edges[i])
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return out


def one_hot(col: str, levels, prefix: str) -> dict[str, Column]:
    """Indicator columns for every level but the first."""
    return {f"{prefix}_{v}": (F.col(col) == F.lit(v)).cast("double") for v in list(levels)[1:]}
