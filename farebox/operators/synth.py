"""Synthetic control over a long panel (unit, t, y)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farebox.session import attach_row, materialize

MIN_WEIGHT = 1e-4  # fixed value: smaller donor weights are set to zero
# Units a pool starts with, and that enter at a time: products among them are their square for each treated unit.
POOL = 64
ENTERS = 1e-10  # of the products' size: a unit outside the pool enters above this


def season_normalize(panel: DataFrame, before, unit: str, season: str, value: str) -> DataFrame:
    """Divide each value by the unit's mean of the same season before the intervention.

    ``before`` is the condition that marks rows before it; nothing later enters the means.
    Adds ``dow_mean`` and ``norm``.
    """
    means = panel.where(before).groupBy(unit, season).agg(F.avg(value).alias("dow_mean"))
    return panel.join(means, [unit, season], "left").withColumn("norm", F.col(value) / F.col("dow_mean"))


def gram_cells(panel: DataFrame, unit: str, t: str, y: str) -> DataFrame:
    """Cross products of each pair of units as rows (i, j, v, n): ``v`` is the mean over the ``n``
    times at which both units have a value.

    Every pair is averaged over its own times, so a unit with gaps doesn't shorten the others'
    series. The values of one time are one row (one value per unit there); each Arrow batch of
    times is a partial matrix, so what is shuffled are pairs per batch, not pairs per time.
    """
    rows = panel.select(F.col(unit).alias("u"), F.col(t).alias("t"), F.col(y).cast("double").alias("y"))
    rows = rows.where("u IS NOT NULL AND t IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)")
    by_time = rows.groupBy("t").agg(F.collect_list(F.struct("u", "y")).alias("row")).select("row")
    kind = rows.schema["u"].dataType.simpleString()

    def partial(batches):
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            names, number = np.unique(flat.field("u").to_numpy(zero_copy_only=False), return_inverse=True)
            values = np.zeros((len(lists), len(names)))
            here = np.zeros((len(lists), len(names)))
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            values[row, number], here[row, number] = flat.field("y").to_numpy(), 1.0
            v, n = values.T @ values, (here.T @ here).astype(np.int64)
            i, j = np.nonzero(n)
            unit_type = flat.field("u").type
            columns = [pa.array(names[i], unit_type), pa.array(names[j], unit_type), pa.array(v[i, j]), pa.array(n[i, j])]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "v", "n"])

    cells = by_time.mapInArrow(partial, f"i {kind}, j {kind}, v double, n long")
    return cells.groupBy("i", "j").agg((F.sum("v") / F.sum("n")).alias("v"), F.sum("n").alias("n"))


def simplex_weights(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """The weights of :func:`simplex_optimum` without those under ``MIN_WEIGHT``."""
    return without_small(simplex_optimum(gram, cross))


def without_small(w: np.ndarray) -> np.ndarray:
    w = np.where(w < MIN_WEIGHT, 0.0, w)
    return w / w.sum()


def simplex_optimum(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Minimise w'Gw - 2c'w over the unit simplex by an active-set method.

    Starts from the best single donor, adds the donor with the most negative reduced
    gradient, and steps back to the boundary when a weight would turn negative. Raises if the
    conditions of the optimum aren't reached.
    """
    j = len(cross)
    active = [int(np.argmin(np.diag(gram) - 2 * cross))]
    w = np.zeros(j)
    w[active[0]] = 1.0
    scale = max(float(np.abs(gram).max()), 1e-300)
    best, stuck = math.inf, 0
    while True:
        grad = gram @ w - cross
        level = float(w @ grad)
        outside = [i for i in range(j) if i not in active]
        enter = min(outside, key=lambda i: grad[i], default=None)
        if enter is None or grad[enter] >= level - 1e-12 * scale:
            break
        # Every step lowers the loss; rounding alone can keep it where it is.
        loss = float(w @ gram @ w - 2 * cross @ w)
        stuck = 0 if loss < best - 1e-15 * scale else stuck + 1
        best = min(best, loss)
        if stuck > j + 10:
            if grad[enter] >= level - 1e-8 * scale:
                break
            raise ArithmeticError(f"donor weights did not converge: reduced gradient {grad[enter] - level:g}")
        active.append(enter)
        while True:
            k = len(active)
            kkt = np.zeros((k + 1, k + 1))
            kkt[:k, :k] = gram[np.ix_(active, active)]
            kkt[:k, k] = kkt[k, :k] = scale
            rhs = np.append(cross[active], scale)
            target = np.linalg.lstsq(kkt, rhs, rcond=1e-14)[0][:k]
            now = w[active]
            falling = target < -1e-14
            if not falling.any():
                w[:] = 0.0
                w[active] = np.clip(target, 0, None)
                break
            drop = now - target
            steps = np.where(falling & (drop > 0), now / np.where(drop > 0, drop, 1.0), np.inf)
            step = min(1.0, float(steps.min()))
            moved = now + step * (target - now)
            w[:] = 0.0
            w[active] = np.clip(moved, 0, None)
            gone = int(np.argmin(steps))
            active.pop(gone)
            if len(active) == 1:
                w[:] = 0.0
                w[active[0]] = 1.0
                break
        w /= w.sum()
    return w


def synthetic_control_weights(
    panel: DataFrame, unit: str, t: str, y: str, treated: list | None = None, donors: int = POOL
) -> DataFrame:
    """Donor weights (treated, donor, w) from pre-intervention rows.

    ``treated=None`` fits every unit against all others (placebos in space); each treated unit is a
    task of its own. A task starts with the ``donors`` units closest to it by mean squared distance
    (ties by code). The reduced gradient of every unit outside is then computed from the weights
    by a join with the products of pairs; the ``donors`` units that would lower the loss most enter,
    and the fit is repeated until no unit would. So the weights are those of all other units,
    and a task holds the products of the units that entered.

    A pair that never has values at the same time has no product: such a donor is left out of the
    pool, and one outside that lacks a product with a donor in use can't enter and has no row.
    """
    cells = materialize(gram_cells(panel, unit, t, y))
    kind = panel.schema[unit].dataType.simpleString()
    own = cells.where("i = j").select(F.col("i").alias("u"), F.col("v").alias("square"))
    pairs = cells.where("i != j").withColumnsRenamed({"i": "treated", "j": "donor", "v": "cross"}).drop("n")
    if treated is not None:
        pairs = pairs.where(F.col("treated").isin(treated))
    pairs = pairs.join(own.withColumnsRenamed({"u": "donor", "square": "donor_square"}), "donor")
    near = W.partitionBy("treated").orderBy(F.col("donor_square") - 2 * F.col("cross"), "donor")
    placed = materialize(pairs.withColumn("place", F.row_number().over(near)))
    pool = placed.where(F.col("place") <= donors).select("treated", "donor", "cross")
    outside = placed.where(F.col("place") > donors).select("treated", "donor", "cross")
    result = ["treated", "donor", "w"]
    if outside.isEmpty():
        return fit_pools(pool, cells, kind).select(*result)
    settled = None
    while True:
        fitted = materialize(fit_pools(pool, cells, kind))
        used = fitted.where("exact > 0").select("treated", F.col("donor").alias("i"), "exact", "level", "scale")
        count = used.groupBy("treated").agg(F.count("*").alias("used"))
        products = used.join(cells.select("i", F.col("j").alias("donor"), "v"), "i").groupBy("treated", "donor")
        products = products.agg(F.sum(F.col("exact") * F.col("v")).alias("at"), F.count("*").alias("have"), F.first("level").alias("level"), F.first("scale").alias("scale"))
        priced = outside.join(products, ["treated", "donor"]).join(count, "treated").where("have = used")
        priced = materialize(priced.withColumn("lower", F.col("level") - (F.col("at") - F.col("cross"))))
        wanted = priced.where(F.col("lower") > ENTERS * F.col("scale"))
        first = W.partitionBy("treated").orderBy(F.col("lower").desc(), "donor")
        entering = materialize(wanted.withColumn("place", F.row_number().over(first)).where(F.col("place") <= donors).select("treated", "donor", "cross"))
        again = entering.select("treated").distinct()
        ready = fitted.select(*result).unionByName(priced.select("treated", "donor", F.lit(0.0).alias("w")))
        ready = ready.join(again, "treated", "left_anti")
        settled = ready if settled is None else settled.unionByName(ready)
        if entering.isEmpty():
            return settled
        pool = materialize(pool.join(again, "treated", "left_semi").unionByName(entering))
        outside = materialize(outside.join(again, "treated", "left_semi").join(entering, ["treated", "donor"], "left_anti"))


def fit_pools(pool: DataFrame, cells: DataFrame, kind: str) -> DataFrame:
    """(treated, donor, w, exact, level, scale): weights over the pool of each treated unit, ``exact`` with the
    small ones, the reduced gradient of the donors in use and the size of the products."""
    # Products among the donors of each pool: at most donors squared for every treated unit.
    first, second = pool.select("treated", "donor", "cross"), pool.select("treated", F.col("donor").alias("other"))
    among = first.join(second, "treated").join(cells.select(F.col("i").alias("donor"), F.col("j").alias("other"), "v"), ["donor", "other"], "left")

    def solve(table: pa.Table) -> pa.Table:
        donor, other = (table.column(c).to_numpy() for c in ("donor", "other"))
        names, row = np.unique(donor, return_inverse=True)
        column = np.searchsorted(names, other)
        gram, cross = np.full((len(names), len(names)), np.nan), np.zeros(len(names))
        gram[row, column] = table.column("v").to_numpy()
        cross[row] = table.column("cross").to_numpy()
        while np.isnan(gram).any():  # leave out the donor that lacks the most pairs
            keep = np.arange(len(names)) != np.isnan(gram).sum(axis=1).argmax()
            names, gram, cross = names[keep], gram[np.ix_(keep, keep)], cross[keep]
        exact = simplex_optimum(gram, cross)
        level, scale = float(exact @ (gram @ exact - cross)), float(np.abs(gram).max())
        one = pa.array([table.column("treated")[0].as_py()] * len(names), table.schema.field("treated").type)
        return pa.table({"treated": one, "donor": pa.array(names, table.schema.field("donor").type)} | {
            k: pa.array(v) for k, v in [("w", without_small(exact)), ("exact", exact), ("level", np.full(len(names), level)), ("scale", np.full(len(names), scale))]
        })

    return among.groupBy("treated").applyInArrow(solve, f"treated {kind}, donor {kind}, w double, exact double, level double, scale double")


def synth_gap(panel: DataFrame, weights: DataFrame, unit: str, t: str, y: str) -> DataFrame:
    """Actual, synthetic and gap per treated unit and time.

    ``weights`` is a donor table (one row per treated unit and donor with weight): the join
    multiplies a panel row only by the treated units that use it as a donor.
    """
    donors = weights.where("w > 0").select("treated", F.col("donor").alias(unit), "w")
    synthetic = (
        panel.select(unit, t, y).join(donors, unit)
        .groupBy("treated", t).agg(F.sum(F.col("w") * F.col(y)).alias("synth"))
    )
    actual = panel.select(F.col(unit).alias("treated"), t, F.col(y).alias("actual"))
    return actual.join(synthetic, ["treated", t]).withColumn("gap", F.col("actual") - F.col("synth"))


def synth_fit_stats(gaps: DataFrame, before) -> DataFrame:
    """RMSPE, RMSPE in per cent of the mean, and R2 before the intervention, per treated unit."""
    return (
        gaps.where(before).groupBy("treated")
        .agg(
            F.sqrt(F.avg(F.col("gap") * F.col("gap"))).alias("rmspe"),
            F.avg("actual").alias("_mean"),
            (1 - F.var_pop("gap") / F.nullif(F.var_pop("actual"), F.lit(0.0))).alias("r2"),
        )
        .select("treated", "rmspe", (F.col("rmspe") / F.col("_mean") * 100).alias("rmspe_pct"), "r2")
    )


def rmspe_ratios(gaps: DataFrame, before, during) -> DataFrame:
    """RMSPE before and during the intervention and their ratio (null when the fit is perfect)."""
    sq = F.col("gap") * F.col("gap")
    return (
        gaps.groupBy("treated")
        .agg(
            F.sqrt(F.avg(F.when(before, sq))).alias("rmspe_pre"),
            F.sqrt(F.avg(F.when(during, sq))).alias("rmspe_post"),
        )
        .withColumn("ratio", F.when(F.col("rmspe_pre") > 0, F.col("rmspe_post") / F.col("rmspe_pre")))
    )


def permutation_test(ratios: DataFrame, treated, limit: float = 2.0) -> DataFrame:
    """Share of comparable placebos whose ratio reaches that of the treated unit.

    Placebos whose pre-period error exceeds ``limit`` times the treated one are left out.
    """
    is_t = F.col("treated") == F.lit(treated)
    own = ratios.agg(
        F.max(F.when(is_t, F.col("rmspe_pre"))).alias("_pre"), F.max(F.when(is_t, F.col("ratio"))).alias("_ratio")
    )
    valid = ~is_t & (F.col("rmspe_pre") <= limit * F.col("_pre"))
    # A placebo without a ratio (perfect fit) doesn't reach it; without one for the treated unit there is no p.
    reached = F.when(F.col("_ratio").isNotNull(), F.coalesce((F.col("ratio") >= F.col("_ratio")).cast("double"), F.lit(0.0)))
    return attach_row(ratios, own).agg(
        F.max("_ratio").alias("ratio"),
        F.sum(valid.cast("long")).alias("n_placebos"),
        F.avg(F.when(valid, reached)).alias("p_value"),
    )


def lost_demand(gaps: DataFrame, panel: DataFrame, before, during, unit: str, season: str, season_of, value: str) -> DataFrame:
    """Demand lost per treated unit during the intervention.

    Gaps are scaled back by the unit's pre-period season mean (1 where unknown).
    """
    pre = panel.where(before)
    base = pre.groupBy(F.col(unit).alias("treated"), season).agg(F.avg(value).alias("dow_mean"))
    level = pre.groupBy(F.col(unit).alias("treated")).agg(F.avg(value).alias("pre_mean"))
    scaled = gaps.where(during).withColumn(season, season_of).join(base, ["treated", season], "left").withColumn(
        "lost", -F.col("gap") * F.coalesce("dow_mean", F.lit(1.0))
    )
    return (
        scaled.groupBy("treated")
        .agg(F.sum("lost").alias("total_lost"), F.avg("lost").alias("daily_lost"), F.count("*").alias("n_dias"))
        .join(level, "treated", "left")
        .withColumn("pct_lost", F.col("total_lost") / (F.col("pre_mean") * F.col("n_dias")) * 100)
    )


def pre_post_means(panel: DataFrame, before, during, unit: str, value: str) -> DataFrame:
    """Mean before and during, reduction in per cent and days in between, per unit."""
    return (
        panel.groupBy(unit)
        .agg(
            F.avg(F.when(before, F.col(value))).alias("pre_mean"),
            F.avg(F.when(during, F.col(value))).alias("post_mean"),
            F.sum(F.when(during, 1).otherwise(0)).alias("n_dias"),
        )
        .withColumn("reduccion_pct", (1 - F.col("post_mean") / F.col("pre_mean")) * 100)
    )


def other_units_mean(panel: DataFrame, treated, unit: str, t: str, value: str) -> DataFrame:
    """Mean of all other units at each time."""
    return panel.where(F.col(unit) != F.lit(treated)).groupBy(t).agg(F.avg(value).alias("sys_mean"))
