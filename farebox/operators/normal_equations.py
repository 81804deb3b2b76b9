"""Cross products of centred regressors.

The regressors are one array column: plans stay small with dozens of indicator columns, means and
score sums are vector aggregates inside the JVM, and products are matrix products over Arrow batches.

The vector handed to the solver is, per group: the upper triangle of sum n*z*z' with
z = (regressors, outcomes) centred; squared deviations of each outcome inside cells; rows; absorbed
means; sum n*mean per column; sum n*mean^2 per regressor. Several models share it: each uses one
outcome and some of the regressors, and has zeros for the others in its coefficients.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.session import attach_row

FULL_LEVERAGE = 1 - 1e-9


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equality join that also matches null keys; without keys ``right`` is one row."""
    if not keys:
        return attach_row(left, right)
    cond = None
    for k in keys:
        right = right.withColumnRenamed(k, f"_r_{k}")
        eq = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = eq if cond is None else cond & eq
    return left.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])


def matrix(column: pa.Array) -> np.ndarray:
    """Numbers of a column; lists of one length as rows."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def unpack(vec, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric q x q matrix from its upper triangle, and what follows it."""
    vec = np.asarray(vec, dtype=float)
    m = q * (q + 1) // 2
    gram = np.zeros((q, q))
    gram[np.triu_indices(q)] = vec[:m]
    return gram + gram.T - np.diag(np.diag(gram)), vec[m:]


@dataclass
class Part:
    """One model: the number of its outcome and those of its regressors, controls first."""

    outcome: int
    use: list[int]


class NormalEquations:
    def __init__(self, names: list[str], outcomes: list[str], parts: list[Part], by: list[str], entity: list[str], extra_key: list[str]):
        self.names, self.outcomes, self.parts, self.by, self.entity = names, outcomes, parts, by, entity
        self.keys = by + entity + extra_key

    def cells(self, df: DataFrame, compress: bool) -> DataFrame:
        pack = lambda columns: F.expr("array(" + ", ".join(f"CAST(`{c}` AS DOUBLE)" for c in columns) + ")")
        for y in self.outcomes:
            df = df.where(usable_outcome(y, self.entity))
        rows = df.select(*self.keys, pack(self.names).alias("_x"), pack(self.outcomes).alias("_y"))
        return merge_cells(rows, [*self.keys, "_x"], compress, len(self.outcomes))

    def complete(self, cells: DataFrame) -> DataFrame:
        """Cells without missing regressors, for cells read back from storage."""
        return cells.where("forall(_x, v -> v IS NOT NULL AND NOT isnan(v))")

    def centre(self, cells: DataFrame) -> DataFrame:
        vector = array_to_vector(F.concat("_x", "_y"))
        means = cells.groupBy(*self.by, *self.entity).agg(
            F.sum("_n").alias("_ne"),
            Summarizer.metrics("mean").summary(vector, F.col("_n")).alias("_s"),
        )
        means = means.where("_ne IS NOT NULL").select(
            *self.by, *self.entity, "_ne", vector_to_array("_s.mean").alias("_mean")
        )
        return join_groups(cells, means, self.by + self.entity)

    def _fold(self, df: DataFrame, columns: list[str], product) -> DataFrame:
        """Apply ``product`` to the rows of each group in each batch and add up the vectors."""
        by = self.by
        narrow = df.select(*by, *columns)
        schema = T.StructType([narrow.schema[c] for c in by] + [T.StructField("_v", T.ArrayType(T.DoubleType()))])

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                data = {c: matrix(batch.column(c)) for c in columns}
                number = np.zeros(batch.num_rows, np.int64)
                if by:
                    number = batch.select(by).to_pandas().groupby(by, sort=False, dropna=False).ngroup().to_numpy()
                order = np.argsort(number, kind="stable")
                heads = np.flatnonzero(np.diff(number[order], prepend=-1))
                vectors = [product({c: v[rows] for c, v in data.items()}) for rows in np.split(order, heads[1:])]
                first = pa.array(order[heads])
                keys = [batch.column(c).take(first) for c in by]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(vectors, pa.list_(pa.float64()))], names=[*by, "_v"])

        parts = narrow.mapInArrow(run, schema)
        total = Summarizer.metrics("sum").summary(array_to_vector("_v")).alias("_s")
        # No parts at all leave a null vector; the solver skips it.
        return parts.groupBy(*by).agg(total, F.count("*").alias("_parts")).where("_parts > 0").select(
            *by, vector_to_array("_s.sum").alias("_gram")
        )

    def gram(self, centred: DataFrame) -> DataFrame:
        p = len(self.names)
        iu = np.triu_indices(p + len(self.outcomes))

        def product(part):
            n, mean = part["_n"], part["_mean"]
            z = np.column_stack([part["_x"], part["_y"]]) - mean
            gram = (z * n[:, None]).T @ z
            tail = [n.sum(), (n / part["_ne"]).sum()]
            return np.concatenate([gram[iu], part["_m2"].sum(axis=0), tail, n @ mean, n @ (mean[:, :p] ** 2)])

        return self._fold(centred, ["_x", "_y", "_mean", "_n", "_ne", "_m2"], product)

    def meat(self, centred: DataFrame, solved: DataFrame, cov: str, cluster: str | None) -> DataFrame:
        """Products of the scores, model after model; ``solved`` has the models' coefficients end to end."""
        p, parts = len(self.names), self.parts
        iu = np.triu_indices(p)
        df = join_groups(centred, solved.select(*self.by, "b", *(["a"] if cov == "hc3" else [])), self.by)
        if cov == "cluster":
            return self._cluster_meat(df, cluster)

        def product(part):
            n, ne, mean = (part[c] for c in ("_n", "_ne", "_mean"))
            z = part["_x"] - mean[:, :p]
            betas, inverses = part["b"][0].reshape(-1, p), part["a"][0].reshape(-1, p, p)
            out = []
            for model, beta, a in zip(parts, betas, inverses):
                e = part["_y"][:, model.outcome] - mean[:, p + model.outcome] - z @ beta
                lever = 1 / ne + ((z @ a) * z).sum(axis=1)
                full = lever >= FULL_LEVERAGE
                squares = part["_m2"][:, model.outcome] + n * e * e
                w = np.where(full, 0.0, squares / np.where(full, 1.0, 1 - lever) ** 2)
                bad = float((full & (np.abs(z[:, model.use]).max(axis=1) > 1e-9)).sum())
                out += [((z * w[:, None]).T @ z)[iu], [bad, squares.sum()]]
            return np.concatenate(out)

        return self._fold(df, ["_x", "_y", "_mean", "_n", "_m2", "_ne", "b", "a"], product)

    def _cluster_meat(self, df: DataFrame, cluster: str) -> DataFrame:
        p, models = len(self.names), len(self.parts)
        iu = np.triu_indices(p)
        # Residuals and scores stay inside the JVM; only one vector per cluster goes to Arrow.
        df = df.withColumn("_z", F.expr("zip_with(_x, slice(_mean, 1, size(_x)), (v, m) -> v - m)"))
        for k, model in enumerate(self.parts):
            y = model.outcome
            fitted = f"aggregate(zip_with(_z, slice(b, {k * p + 1}, {p}), (v, w) -> v * w), 0.0D, (s, v) -> s + v)"
            df = df.withColumn(f"_e{k}", F.expr(f"_y[{y}] - _mean[{p + y}] - {fitted}"))
        rss = [F.expr(f"_m2[{model.outcome}] + _n * _e{k} * _e{k}") for k, model in enumerate(self.parts)]
        score = F.concat(*[F.expr(f"transform(_z, v -> v * _n * _e{k})") for k in range(models)], F.array(*rss))
        keys = self.by + ([cluster] if cluster not in self.by else [])
        scores = df.withColumn("_score", score).groupBy(*keys).agg(
            Summarizer.metrics("sum").summary(array_to_vector("_score")).alias("_s")
        ).select(*self.by, vector_to_array("_s.sum").alias("_score"))

        def product(part):
            s, out = part["_score"], []
            for k in range(models):
                own = s[:, k * p:(k + 1) * p]
                out += [(own.T @ own)[iu], [0.0, s[:, models * p + k].sum()]]
            return np.concatenate(out)

        return self._fold(scores, ["_score"], product)


def usable_outcome(y: str, keys: list[str]) -> str:
    parts = [f"`{y}` IS NOT NULL AND NOT isnan(CAST(`{y}` AS DOUBLE))"]
    return " AND ".join(parts + [f"`{c}` IS NOT NULL" for c in keys])


def merge_cells(rows: DataFrame, keys: list[str], compress: bool, outcomes: int) -> DataFrame:
    """Rows with equal keys as one cell: count, mean outcomes, squared deviations from them."""
    if not compress:
        return rows.withColumns({"_n": F.lit(1.0), "_m2": F.array(*[F.lit(0.0)] * outcomes)})
    each = [F.col("_y")[k] for k in range(outcomes)]
    return (
        rows.groupBy(*keys)
        .agg(F.count("*").cast("double").alias("_n"), F.array(*map(F.avg, each)).alias("_y"), F.array(*map(F.var_pop, each)).alias("_var"))
        .select(*keys, "_y", "_n", F.expr("transform(_var, v -> _n * v)").alias("_m2"))
    )
