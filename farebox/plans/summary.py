"""One comparable table of all estimated effects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.functions.numeric import percent, stars

SMALL_LIMIT = 20.0


def effect_rows(coefs: DataFrame, estudio: str, choque: str, metodo: str, scale: float = 1.0) -> DataFrame:
    """Log-point coefficients (b, lo, hi, p) as per cent effects of one study."""
    pct = lambda c: percent(F.col(c) * scale)
    return coefs.select(
        F.lit(estudio).alias("estudio"), F.lit(choque).alias("choque"), F.lit(metodo).alias("metodo"),
        pct("b").alias("efecto_pct"), pct("lo").alias("lo95_pct"), pct("hi").alias("hi95_pct"), F.col("p").alias("pval"),
    )


def gap_rows(loss: DataFrame, test: DataFrame, estudio: str, choque: str) -> DataFrame:
    """Loss of a synthetic-control study (negative per cent, permutation p, no interval)."""
    none = F.lit(None).cast("double")
    return loss.select((-F.col("pct_lost")).alias("efecto_pct")).join(F.broadcast(test.select("p_value"))).select(
        F.lit(estudio).alias("estudio"), F.lit(choque).alias("choque"), F.lit("Control sintético").alias("metodo"),
        "efecto_pct", none.alias("lo95_pct"), none.alias("hi95_pct"), F.col("p_value").alias("pval"),
    )


def effect_table(parts: list[DataFrame], level: float = 0.05) -> DataFrame:
    """Union of studies with a significance flag and a small/large split at 20 per cent."""
    table = reduce(DataFrame.unionByName, parts)
    return table.withColumns({
        "sig": F.coalesce(F.col("pval") < level, F.lit(False)),
        "marca": F.coalesce(stars("pval"), F.lit("")),
        "escala": F.when(F.col("efecto_pct").between(-SMALL_LIMIT, SMALL_LIMIT), "pequeño").otherwise("grande"),
    })
