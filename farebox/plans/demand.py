"""Demand model: features, scaling, random forest and batch scoring."""

from __future__ import annotations

import uuid

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.schemas import MAX_DEMAND_FALLBACK, ZONE_LETTERS
from farebox.session import attach_row, checkpoint_dir

# ---- fixed values: names, order and defaults the published model was trained with ----
LETTER_COLUMNS = [f"Letra_{z}" for z in ZONE_LETTERS]
FEATURES = ["Mes", "Día", "Hora", "Minuto", "Segundo", *LETTER_COLUMNS, "lat", "lon"]
TARGET = "Entradas"
DEPTH = 5
MODEL_NAME = f"Random Forest (max_depth={DEPTH})"
# Defaults of a scenario that leaves a field out.
SCENARIO_DEFAULTS = {
    "mes": 4, "dia": 1, "hora": 7, "minuto": 0, "segundo": 0, "letra_zona": "A", "lat": 4.6097, "lon": -74.0817,
}


def demand_features(scenarios: DataFrame) -> DataFrame:
    """Feature columns of scenarios (mes, dia, hora, minuto, segundo, letra_zona, lat, lon).

    Missing columns take their defaults. The letter is upper-cased; one outside the known
    zones gives ``exito`` = false with a message, null features, and no prediction.
    """
    have = scenarios.columns
    field = lambda c: F.col(c) if c in have else F.lit(SCENARIO_DEFAULTS[c])
    df = scenarios.withColumns({c: field(c) for c in SCENARIO_DEFAULTS if c not in have})
    df = df.withColumn("letra_zona", F.upper("letra_zona"))
    ok = F.coalesce(F.col("letra_zona").isin(ZONE_LETTERS), F.lit(False))
    source = {"Mes": "mes", "Día": "dia", "Hora": "hora", "Minuto": "minuto", "Segundo": "segundo"}
    features = {name: F.when(ok, F.col(c).cast("double")) for name, c in source.items()}
    features |= {f"Letra_{z}": F.when(ok, (F.col("letra_zona") == z).cast("double")) for z in ZONE_LETTERS}
    features |= {"_lat": F.when(ok, F.col("lat").cast("double")), "_lon": F.when(ok, F.col("lon").cast("double"))}
    bad = F.format_string("Zona '%s' no válida. Use: %s", F.col("letra_zona"), F.lit(str(ZONE_LETTERS)))
    out = df.withColumns({**features, "exito": ok, "mensaje": F.when(ok, "").otherwise(bad)})
    return out.drop("lat", "lon").withColumnsRenamed({"_lat": "lat", "_lon": "lon"})


def fit_scaler(training: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Minimum and maximum of every feature and the target, as one row."""
    columns = columns or [*FEATURES, TARGET]
    return training.agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.min, "min"), (F.max, "max"))])


def minmax_scale(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """Scale to [0, 1]; a constant column becomes 0. The scaler's columns stay for later use."""
    out = attach_row(df, scaler)
    scaled = {
        c: F.when(F.col(f"{c}_max") > F.col(f"{c}_min"), (F.col(c) - F.col(f"{c}_min")) / (F.col(f"{c}_max") - F.col(f"{c}_min")))
        .otherwise(F.col(c) - F.col(f"{c}_min"))
        for c in columns
    }
    return out.withColumns(scaled)


def assemble(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def fit_demand_model(training: DataFrame, scaler: DataFrame, seed: int = 42, trees: int = 100) -> RandomForestRegressionModel:
    """Random forest of depth 5 on scaled features and target. Persist the model with ``.save``."""
    data = assemble(minmax_scale(training, scaler, [*FEATURES, TARGET]))
    forest = RandomForestRegressor(
        featuresCol="features", labelCol=TARGET, predictionCol="pred", maxDepth=DEPTH, numTrees=trees, seed=seed,
        featureSubsetStrategy="all",
    )
    return forest.fit(data.select("features", TARGET))


def model_metrics(model: RandomForestRegressionModel, held_out: DataFrame, scaler: DataFrame) -> dict[str, float]:
    """RMSE and R2 in the scaled space."""
    scored = model.transform(assemble(minmax_scale(held_out, scaler, [*FEATURES, TARGET])))
    return {
        m: RegressionEvaluator(labelCol=TARGET, predictionCol="pred", metricName=m).evaluate(scored) for m in ("rmse", "r2")
    }


def denormalise(pred, low=None, high=None):
    """Scaled prediction to passengers: half-even rounding, never below zero."""
    value = pred * (high - low) + low if low is not None else pred * MAX_DEMAND_FALLBACK
    return F.when(value.isNotNull(), F.greatest(F.rint(value), F.lit(0.0))).cast("long")


# A fitted forest as rows: inner nodes have a feature (a position in FEATURES) and go to ``low`` up to the
# threshold, else to ``high``; leaves have the feature -1. Nodes of a tree are numbered from 0, the root.
NODES = "tree int, node int, feature int, threshold double, low int, high int, value double"


def forest_nodes(model: RandomForestRegressionModel) -> DataFrame:
    """The nodes of a fitted forest, from the table that the model is saved as."""
    spark = SparkSession.active()
    path = f"{checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    leaf = F.col("leftChild") < 0
    return saved.select(
        F.col("treeID").cast("int").alias("tree"), F.col("id").cast("int").alias("node"),
        F.when(leaf, -1).otherwise(F.col("split.featureIndex")).cast("int").alias("feature"),
        F.when(leaf, 0.0).otherwise(F.col("split.leftCategoriesOrThreshold")[0]).cast("double").alias("threshold"),
        F.col("leftChild").cast("int").alias("low"), F.col("rightChild").cast("int").alias("high"), F.col("prediction").alias("value"),
    )


def walk_forest(df: DataFrame, nodes: DataFrame, features: str, out: str, depth: int = DEPTH) -> DataFrame:
    """Add the mean over all trees of the leaf that the array ``features`` leads to, in ``depth`` steps at most.

    The forest is one row of arrays, as big as the model, beside every row; a walk is a fold over the
    levels, so rows are neither multiplied nor moved. A walk that ends at no leaf is an error.
    """
    entry = F.struct("node", "feature", "threshold", "low", "high", "value")
    trees = nodes.groupBy("tree").agg(F.sort_array(F.collect_list(entry)).alias("t"))
    forest = trees.agg(F.collect_list("t").alias("_forest"))
    step = "CASE WHEN t[n].feature < 0 THEN n WHEN {x}[t[n].feature] <= t[n].threshold THEN t[n].low ELSE t[n].high END".format(x=features)
    walk = f"t[aggregate(sequence(1, {depth}), 0, (n, k) -> {step})]"
    leaves = F.expr(f"transform(_forest, t -> {walk})")
    values = F.transform(leaves, lambda n: F.when(n["feature"] < 0, n["value"]).otherwise(F.raise_error(F.lit("trees deeper than stated")).cast("double")))
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    return attach_row(df, forest).withColumn(out, mean).drop("_forest")


def score_scenarios(scenarios: DataFrame, model: RandomForestRegressionModel | DataFrame, scaler: DataFrame | None) -> DataFrame:
    """Predictions for all scenarios in one pass; failed rows keep their message.

    ``model`` is a fitted forest or its table of nodes (``NODES``).

    Without a scaler the features enter as they are and the published maximum is used.
    """
    # Feature names differ from scenario fields by case only, so the fields are kept aside.
    df = demand_features(scenarios.withColumn("_in", F.struct(*scenarios.columns)))
    if scaler is not None:
        ready = minmax_scale(df, scaler, FEATURES)
        low, high = F.col(f"{TARGET}_min"), F.col(f"{TARGET}_max")
    else:
        ready, low, high = df, None, None
    values = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in FEATURES])
    if isinstance(model, DataFrame):
        scored = walk_forest(ready.withColumn("features", values), model, "features", "pred")
    else:
        scored = model.transform(ready.withColumn("features", array_to_vector(values)))
    pred = F.when(F.col("exito"), F.col("pred"))
    return scored.select(
        "_in.*",
        F.round(pred, 6).alias("prediccion_normalizada"),
        denormalise(pred, low, high).alias("prediccion_entradas"),
        F.lit(MODEL_NAME).alias("modelo_utilizado"), "exito", "mensaje",
    )
