"""MLlib forecasts: ridge, forest, boosted trees, sequence regressors, grid search, stacking.

A fitted pipeline starts with the assembler that names its features and ends with ``y_pred`` in
case units, so a model loaded from disk needs nothing but the pipeline.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool
from types import MappingProxyType
from typing import NamedTuple

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.measures import log_target, outbreak_weight
from weekloom.keys import DEFAULT_KEYS, Keys
from weekloom.operators.features import complete_rows, fit_scaler, sequence_windows
from weekloom.operators.folds import assign_folds
from weekloom.operators.forecast import long_predictions, target_of
from weekloom.session import settled

SEED = 42
LAGGED = tuple(range(1, 5))

# The feature lists of the models.
CASE_LAG_FEATURES = [f"{p}_lag{k}" for p in ("cases", "incidence") for k in LAGGED]
NEIGHBOUR_FEATURES = ["neighbour_cases_lag1", "neighbour_incidence_lag1"]
WEATHER_FEATURES = [
    "temp_mean", "precipitation", "humidity_mean", "heat_index_mean",
    "temp_mean_anomaly", "precipitation_anomaly", "humidity_mean_anomaly",
]
WEATHER_LAG_FEATURES = [f"{m}_lag{k}" for m in WEATHER_FEATURES for k in LAGGED]
SEASON_FEATURES = ["week_sin", "week_cos", "in_season", "month"]
PLACE_FEATURES = ["entity_id", "is_focus", "population"]
RIDGE_FEATURES = WEATHER_FEATURES + WEATHER_LAG_FEATURES + SEASON_FEATURES + PLACE_FEATURES
FOREST_FEATURES = CASE_LAG_FEATURES + RIDGE_FEATURES
BOOSTED_FEATURES = CASE_LAG_FEATURES + NEIGHBOUR_FEATURES + RIDGE_FEATURES
SEQUENCE_FEATURES = (
    [f"{f}_norm" for f in CASE_LAG_FEATURES] + NEIGHBOUR_FEATURES
    + [f"{f}_norm" for f in WEATHER_LAG_FEATURES] + SEASON_FEATURES + ["is_focus", "population"]
)

# Hyperparameters of the boosted grid search.
BOOSTED_GRID = {
    "maxIter": [100, 300, 500],
    "maxDepth": [3, 5, 7],
    "stepSize": [0.05, 0.1],
    "subsamplingRate": [0.8, 1.0],
    "minInstancesPerNode": [1, 5],
}

_CLIPPED = "CASE WHEN {0} IS NOT NULL THEN greatest({0}, 0.0D) END"


def resolve_features(rows: DataFrame, features: Sequence[str]) -> list[str]:
    """The features as given; raises when one is absent instead of training without it."""
    missing = [f for f in features if f not in rows.columns]
    if missing:
        raise ValueError(f"features not in the table: {missing}")
    return list(features)


# Columns of an encoded entity inside a pipeline.
ENTITY_NAME, ENTITY_INDEX, ENTITY_VECTOR = "entity_name", "entity_index", "entity_vector"


def entity_stages(entity: str) -> list:
    """Stages that turn an entity into one sparse 0/1 vector, whatever the size of its domain.

    The domain is learned in the fit and saved with the pipeline. An entity that the fit has not
    seen keeps its rows: its vector is all zeros, so it is scored as the average entity.
    """
    return [
        SQLTransformer(statement=f"SELECT *, CAST(`{entity}` AS STRING) AS {ENTITY_NAME} FROM __THIS__"),
        StringIndexer(inputCol=ENTITY_NAME, outputCol=ENTITY_INDEX, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=[ENTITY_INDEX], outputCols=[ENTITY_VECTOR], dropLast=True),
    ]


def fit_ridge(train: DataFrame, features: Sequence[str] = RIDGE_FEATURES, target: str = "cases",
              alpha: float = 1.0, entity: str | None = None) -> PipelineModel:
    """L2-penalised linear fit on standardised features, prediction not below 0.

    ``alpha`` penalises the sum of squares over rows. MLlib averages over rows, divides the
    penalty by the deviation of the label, and its scaler uses the sample deviation of the
    features; the factor on the penalty makes up for all three. ``entity`` adds a coefficient for
    each entity as a sparse vector, which is not standardised.
    """
    usable = _usable(train, features, target, [entity] if entity else ())
    size = usable.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("deviation")).first()
    n, deviation = size["n"], size["deviation"]
    if not n:
        raise ValueError(f"no complete training row for {target}")
    penalty = alpha * deviation * (n - 1) / n / n
    stages = [_assembler(usable, features, "raw_features")]
    if entity:
        # Sparse columns are not scaled, so their penalty needs no correction for the sample deviation.
        stages += [StandardScaler(inputCol="raw_features", outputCol="scaled_features", withMean=True, withStd=True), *entity_stages(entity),
                   VectorAssembler(inputCols=["scaled_features", ENTITY_VECTOR], outputCol="features"),
                   LinearRegression(labelCol=target, elasticNetParam=0.0, standardization=False, regParam=alpha * deviation / n,
                                    solver="auto", maxIter=500, tol=1e-10)]
    else:
        stages += [StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
                   LinearRegression(labelCol=target, elasticNetParam=0.0, standardization=False, regParam=penalty, solver="normal")]
    return Pipeline(stages=[*stages, _output()]).fit(usable)


def fit_forest(train: DataFrame, features: Sequence[str] = FOREST_FEATURES, target: str = "cases",
               trees: int = 300, depth: int = 10, min_leaf: int = 5, entity: str | None = None) -> PipelineModel:
    """Random forest; ``entity`` adds the entity as a sparse vector of any size."""
    usable = _usable(train, features, target, [entity] if entity else ())
    forest = RandomForestRegressor(
        labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf,
        featureSubsetStrategy="all", seed=SEED)
    stages = [_assembler(usable, features)]
    if entity:
        stages = [_assembler(usable, features, "raw_features"), *entity_stages(entity),
                  VectorAssembler(inputCols=["raw_features", ENTITY_VECTOR], outputCol="features")]
    return Pipeline(stages=[*stages, forest, _output()]).fit(usable)


def entity_domain(model: PipelineModel) -> list[str]:
    """The entities a pipeline was fitted on, in the order of their vector; empty without such a vector."""
    indexers = [s for s in model.stages if isinstance(s, StringIndexerModel)]
    return list(indexers[0].labels) if indexers else []


def fit_boosted(train: DataFrame, features: Sequence[str] = BOOSTED_FEATURES, target: str = "cases",
                validation: DataFrame | None = None, **params) -> PipelineModel:
    """Boosted trees on the log of the target, back in case units.

    With ``validation`` rows, boosting stops once they no longer improve. Use rows that are
    not scored later.
    """
    usable = _usable(train, features, target)
    settings = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "featureSubsetStrategy": "0.8",
                **params}
    if validation is not None:
        usable = usable.withColumn("is_validation", F.lit(False)).unionByName(
            _usable(validation, features, target).withColumn("is_validation", F.lit(True)))
        settings["validationIndicatorCol"] = "is_validation"
    logged = usable.withColumn("log_cases", log_target(F.col(target)))
    trees = GBTRegressor(labelCol="log_cases", seed=SEED, **settings)
    return Pipeline(stages=[_assembler(usable, features), trees, _output(log=True)]).fit(logged)


def predict(model: PipelineModel, rows: DataFrame, name: str, horizon: int = 0,
            count: str = "cases", keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Long predictions of a fitted or loaded pipeline, whatever its kind.

    A flat model takes rows with all its features; a sequence model, which names none, takes the
    rows of ``sequence_rows``, which carry their target.
    """
    if not isinstance(model.stages[0], VectorAssembler):
        return predict_sequence(model, rows, name, horizon, keys)
    features = model_features(model)
    resolve_features(rows, features)
    scored = model.transform(complete_rows(rows, features))
    return long_predictions(scored, name, {horizon: F.col("y_pred")}, count, keys)


def model_features(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


def regressor_of(model: PipelineModel):
    """The regression stage, which stands before the output stage."""
    return model.stages[-2]


def sequence_rows(panel: DataFrame, features: Sequence[str] = SEQUENCE_FEATURES,
                  target: str = "cases", length: int = 12, by: Sequence[str] = ("split",),
                  keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Sequences flattened to one vector, with target and outbreak weight."""
    windows = sequence_windows(panel, resolve_features(panel, features), target, length, 0, by, keys)
    return windows.select(
        *keys.panel, *by, array_to_vector(F.flatten("sequence")).alias("features"),
        F.col("target").cast("double").alias("target"),
        outbreak_weight(F.col("target")).alias("weight"))


def fit_sequence(rows: DataFrame, kind: str = "linear", tail: float = 0.15, keys: Keys = DEFAULT_KEYS,
                 **params) -> PipelineModel:
    """Weighted regressor over flattened sequences, in the target's own scale.

    ``linear`` uses the Huber loss, ``boosted`` boosted trees on the log of the target. The range
    of the target in ``rows`` becomes 0..1 for the fit, and the pipeline brings predictions back,
    so each horizon has its own scale. The last weeks, ``tail`` of them, are held out and stop the
    fit: boosting as soon as they no longer improve, the linear solver at the last doubling of its
    iterations that improved them. With fewer than two weeks nothing is held out.
    """
    value = log_target(F.col("target")) if kind == "boosted" else F.col("target")
    valued = rows.withColumn("value", value)
    low, high = valued.agg(F.min("value"), F.max("value")).first()
    if low is None:
        raise ValueError("no training sequence")
    span = (high - low) or 1.0
    scaled = settled(valued.withColumn("scaled", (F.col("value") - low) / span).drop("value"), "sequences")
    weeks = sorted(tuple(r) for r in scaled.select(*keys.time).distinct().collect())  # bounded by the calendar
    held_weeks = min(max(1, round(tail * len(weeks))), len(weeks) - 1) if tail else 0
    week = F.struct(*keys.time)
    late = week >= F.struct(*[F.lit(v) for v in weeks[-held_weeks]]) if held_weeks else F.lit(False)
    output = _output(kind == "boosted", low, span)
    if kind == "boosted":
        settings = {"maxIter": 50, "maxDepth": 4, **params}
        stage = GBTRegressor(labelCol="scaled", weightCol="weight", seed=SEED, **settings)
        if held_weeks:
            scaled, stage = scaled.withColumn("is_late", late), stage.setValidationIndicatorCol("is_late")
        return Pipeline(stages=[stage, output]).fit(scaled)
    settings = {"loss": "huber", "regParam": 0.01, "maxIter": 100, **params}
    limit = settings.pop("maxIter")
    early = scaled.where(~late)

    def fitted(iterations: int) -> PipelineModel:
        stage = LinearRegression(labelCol="scaled", weightCol="weight", maxIter=iterations, **settings)
        return Pipeline(stages=[stage, output]).fit(early)

    if not held_weeks:
        return fitted(limit)
    best, least = None, None
    for iterations in doublings(limit):
        model = fitted(iterations)
        missed = F.col("weight") * F.abs(F.col("y_pred") - F.col("target"))
        error = model.transform(scaled.where(late)).agg((F.sum(missed) / F.sum("weight")).alias("e")).first()["e"]
        if least is not None and error is not None and error >= least:
            break
        best, least = model, error
    return best


def doublings(limit: int) -> list[int]:
    """Iteration counts that double up to the limit, the first at most 13."""
    counts = [limit]
    while counts[-1] > 13:
        counts.append(-(-counts[-1] // 2))
    return counts[::-1]


def predict_sequence(model: PipelineModel, rows: DataFrame, name: str, horizon: int = 0,
                     keys: Keys = DEFAULT_KEYS) -> DataFrame:
    scored = model.transform(rows)
    actual = {horizon: F.col("target")}
    return long_predictions(scored, name, {horizon: F.col("y_pred")}, "target", keys, actual)


def first_rounds(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The model that boosting would have given after fewer rounds: its first trees."""
    kept = min(rounds, model.getNumTrees)
    gateway = SparkContext._active_spark_context._gateway
    package = gateway.jvm.org.apache.spark.ml.regression
    trees, weights = gateway.new_array(package.DecisionTreeRegressionModel, kept), gateway.new_array(gateway.jvm.double, kept)
    all_trees = model._java_obj.trees()
    for i in range(kept):
        trees[i], weights[i] = all_trees[i], float(model.treeWeights[i])
    shorter = GBTRegressionModel(package.GBTRegressionModel(model.uid, trees, weights))
    return shorter.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


def staged(model: PipelineModel, rounds: int) -> PipelineModel:
    """A boosted pipeline cut to its first rounds."""
    return PipelineModel([*model.stages[:-2], first_rounds(regressor_of(model), rounds), model.stages[-1]])


def grid_search(train: DataFrame, folds: DataFrame, features: Sequence[str] = BOOSTED_FEATURES,
                horizon: int = 0, grid: Mapping[str, Sequence] | None = None,
                count: str = "cases", parallelism: int = 4,
                keys: Keys = DEFAULT_KEYS) -> tuple[dict, DataFrame]:
    """Best boosted settings by mean MAE in case units over folds of weeks, and all results.

    Settings that differ in their rounds alone share one fit at the largest number; the others
    are the first trees of that fit. Each fit is a distributed job; the loop runs over settings,
    as MLlib's own validator does.
    """
    spark, target = train.sparkSession, target_of(horizon, count)
    settings = [dict(zip(grid or BOOSTED_GRID, values))
                for values in product(*(grid or BOOSTED_GRID).values())]
    shared: dict[tuple, list[int]] = {}
    for index, setting in enumerate(settings):
        shared.setdefault(tuple(sorted((k, v) for k, v in setting.items() if k != "maxIter")), []).append(index)
    rows = settled(assign_folds(_usable(train, features, target, keep=keys.panel), folds, keys))
    # One number per fold.
    fold_ids = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]

    def score(indices: list[int], fold: int) -> list[tuple[int, int, float | None]]:
        part = rows.where(F.col("fold") == fold)
        largest = max((settings[i] for i in indices), key=lambda s: s.get("maxIter", 0))
        model = fit_boosted(compact(part.where("role = 'train'")), features, target, **largest)
        out = []
        for index in indices:
            cut = staged(model, settings[index]["maxIter"]) if "maxIter" in settings[index] else model
            held = predict(cut, part.where("role = 'validation'"), "boosted", horizon, count, keys)
            mae = held.agg(F.avg(F.abs(F.col("y_real") - F.col("y_pred"))).alias("mae")).first()["mae"]
            out.append((index, fold, mae))
        return out

    jobs = [(i, f) for i in shared.values() for f in fold_ids]
    with ThreadPool(parallelism) as pool:
        results = sorted(r for part in pool.starmap(score, jobs) for r in part)
    names = {i: ", ".join(f"{k}={v}" for k, v in s.items()) for i, s in enumerate(settings)}
    table = spark.createDataFrame(
        [(i, names[i], f, m) for i, f, m in results], "setting int, params string, fold int, mae double")
    scored = {(i, f): m for i, f, m in results if m is not None}
    # Settings are compared on folds that some setting could score, and must have all of those.
    common = sorted({f for _, f in scored})
    means = {i: sum(scored[i, f] for f in common) / len(common) for i in range(len(settings))
             if common and all((i, f) in scored for f in common)}
    if not means:
        raise ValueError("no setting was scored on all folds")
    best = min(means, key=means.__getitem__)
    return settings[best], table


def compact(rows: DataFrame, per_partition: int = 20_000) -> DataFrame:
    """Rows in as few partitions as their number needs; a small fit is mostly scheduling."""
    return rows.coalesce(max(1, -(-rows.count() // per_partition)))


class Fitted(NamedTuple):
    """A fitted model with all that scoring needs: its features and, for a sequence model, the
    length of its windows and the mean and deviation that standardise its ``_norm`` features."""

    name: str
    horizon: int
    pipeline: PipelineModel
    features: Sequence[str]
    length: int = 0
    scaler: Mapping[str, tuple[float, float]] = MappingProxyType({})


def standardised(rows: DataFrame, scaler: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Columns ``name_norm`` from fitted means and deviations; nulls count as 0."""
    return rows.withColumns({
        f"{name}_norm": (F.coalesce(F.col(name).cast("double"), F.lit(0.0)) - mean) / deviation
        for name, (mean, deviation) in scaler.items()})


def fit_flat(fit: Callable[..., PipelineModel], train: DataFrame, name: str, horizon: int = 0, count: str = "cases", **params) -> Fitted:
    """A model over rows, as ``fit_ridge``, ``fit_forest`` and ``fit_boosted`` make it."""
    model = fit(train, target=target_of(horizon, count), **params)
    return Fitted(name, horizon, model, model_features(model))


def fit_windows(train: DataFrame, name: str, horizon: int = 0, kind: str = "linear", features: Sequence[str] = SEQUENCE_FEATURES,
                length: int = 12, by: Sequence[str] = (), count: str = "cases", keys: Keys = DEFAULT_KEYS, **params) -> Fitted:
    """A sequence model with the scaler of its training rows."""
    raw = [f.removesuffix("_norm") for f in features if f.endswith("_norm")]
    scaler = {}
    if raw:
        fitted = fit_scaler(train, raw).first()  # one row
        scaler = {c: (fitted[c]["mean"], fitted[c]["deviation"]) for c in raw}
    rows = sequence_rows(standardised(train, scaler), features, target_of(horizon, count), length, by, keys)
    return Fitted(name, horizon, fit_sequence(compact(settled(rows, "windows")), kind, keys=keys, **params), features, length, scaler)


def score_fitted(model: Fitted, rows: DataFrame, by: Sequence[str] = (), count: str = "cases",
                 keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Long predictions of a fitted model; windows restart in every ``by`` group."""
    if not model.length:
        return predict(model.pipeline, rows, model.name, model.horizon, count, keys)
    target = target_of(model.horizon, count)
    windows = sequence_rows(standardised(rows, model.scaler), model.features, target, model.length, by, keys)
    return predict_sequence(model.pipeline, windows, model.name, model.horizon, keys)


Fitter = Callable[[DataFrame], "PipelineModel | Fitted"]


def out_of_fold(train: DataFrame, folds: DataFrame, fitters: Mapping[str, Fitter], horizon: int = 0,
                count: str = "cases", parallelism: int = 4, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Predictions for every validation week of the folds by models that saw only its past.

    The last ``horizon`` training weeks of a fold are left out, since their targets lie in its
    validation weeks. Windows of a sequence model reach back over the fold's edge, to weeks
    before the one they predict from; its scaler is fitted on the fold's training weeks.
    """
    fold_ids = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    backwards = Window.partitionBy("fold", "role").orderBy(*[F.desc(k) for k in keys.time])  # one row per fold and week
    known = folds.withColumn("_back", F.row_number().over(backwards)).where((F.col("role") != "train") | (F.col("_back") > horizon)).drop("_back")
    # Every fold and model reads these rows again.
    rows = settled(assign_folds(train, known, keys))

    def predicted(fold: int, name: str) -> DataFrame:
        part = rows.where(F.col("fold") == fold)
        model = fitters[name](part.where("role = 'train'").drop("fold", "role"))
        held = part.where("role = 'validation'")
        if isinstance(model, PipelineModel):
            return predict(model, held, name, horizon, count, keys)
        if not model.length:
            return score_fitted(model, held, count=count, keys=keys)
        # Embargoed weeks are past by then, so windows hold them too.
        whole = assign_folds(train, folds.where(F.col("fold") == fold), keys).drop("fold", "role")
        marks = [c for c in ("split",) if c in held.columns]
        return score_fitted(model, whole, count=count, keys=keys).join(held.select(*keys.panel, *marks), [*keys.panel])

    with ThreadPool(parallelism) as pool:
        parts = pool.starmap(predicted, [(fold, name) for fold in fold_ids for name in fitters])
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def stack_frame(predictions: DataFrame, models: Sequence[str], keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """One row per key with a column per base model; rows some model lacks are dropped."""
    split = ["split"] if "split" in predictions.columns else []
    wide = predictions.groupBy(*split, *keys.panel).agg(
        F.max("y_real").alias("cases"),
        *[F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(f"base_{m}") for m in models])
    return complete_rows(wide, [f"base_{m}" for m in models])


def fit_stack(base: DataFrame, models: Sequence[str], trees: int = 100, depth: int = 5) -> PipelineModel:
    """Forest over out-of-fold base predictions."""
    return fit_forest(base, [f"base_{m}" for m in models], "cases", trees, depth)


def _usable(rows: DataFrame, features: Sequence[str], target: str,
            keep: Sequence[str] = ()) -> DataFrame:
    names = resolve_features(rows, features)
    columns = list(dict.fromkeys([*keep, *names, target]))
    return complete_rows(rows, [*names, target]).select(*columns)


def _assembler(rows: DataFrame, features: Sequence[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=resolve_features(rows, features), outputCol=output)


def _output(log: bool = False, low: float = 0.0, span: float = 1.0) -> SQLTransformer:
    """The prediction in case units: the scale of the fit undone, not below 0."""
    value = _CLIPPED.format(f"(prediction * {float(span)!r}D + {float(low)!r}D)" if (low, span) != (0.0, 1.0) else "prediction")
    if log:
        value = f"expm1({value})"
    return SQLTransformer(statement=f"SELECT *, {value} AS y_pred FROM __THIS__")
