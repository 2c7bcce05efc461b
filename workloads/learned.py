"""Fitted forecasts and feature importance. Fitting has no SQL form; the roll-ups have."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.operators import evaluate, features as features_ops, folds as fold_ops, importance, models
from weekloom.operators.forecast import persistence
from weekloom.operators.panel import combine_sources
from weekloom.plans.scoring import ensemble_report, walk_forward_report
from weekloom.session import scratch, settled
from weekloom.sources import bundles
from weekloom.sources.tables import routing_table
from workloads.base import base_table, features, neat, neat_wrap, sql, supplier_panel
from workloads.scoring import BLOCKS

HORIZONS = range(5)
KINDS = ("ridge", "small_forest", "boosted", "sequence_linear", "sequence_boosted")
# What fits cost here is told in the README: the grid has a few rounds, and two values of two parameters;
# bases of the stack have fewer rounds and trees than the models alone.
GRID = {"maxIter": [2, 4, 6], "maxDepth": [3, 5], "stepSize": [0.1], "minInstancesPerNode": [1, 5]}
STACK_ROUNDS, STACK_TREES = 10, 20
SMALL_FOREST = 20  # trees of the forests at all horizons; ``forest`` has the library's 300
ROUTING = {
    0: {"default": "boosted"}, 1: {"default": "persistence"}, 2: {"default": "persistence"},
    3: {"default": "sequence_linear"}, 4: {"default": "sequence_linear"},
}

# Per application and data folder: the feature table, the folder of the bundle, and what it holds.
_TABLES: dict[tuple[str, str], DataFrame] = {}
_BUNDLES: dict[tuple[str, str], tuple[str, dict[tuple[str, int], models.Fitted]]] = {}


def _table(spark, sf):
    key = spark.sparkContext.applicationId, sf
    if key not in _TABLES:
        _TABLES[key] = settled(features(spark, sf), "features")
    return _TABLES[key]


def _held(spark, sf):
    return _table(spark, sf).where("split <> 'train'")


def _fit(table, kind, horizon):
    """A model of one kind and horizon at the library's defaults. Boosting is stopped by the last training year."""
    train = models.compact(table.where("split = 'train'"))
    if kind == "ridge":
        return models.fit_flat(models.fit_ridge, train, kind, horizon)
    if kind == "forest":
        return models.fit_flat(models.fit_forest, train, kind, horizon)
    if kind == "small_forest":
        return models.fit_flat(models.fit_forest, train, kind, horizon, trees=SMALL_FOREST)
    if kind == "boosted":
        early, late = (models.compact(table.where("split = 'train'").where(w)) for w in ("year < 1999", "year = 1999"))
        return models.fit_flat(models.fit_boosted, early, kind, horizon, validation=late)
    return models.fit_windows(train, kind, horizon, kind.removeprefix("sequence_"))


def _models(spark, sf, kinds=KINDS, horizons=HORIZONS):
    """The wanted models, each fitted once per application, saved, and read back from the bundle."""
    table, key = _table(spark, sf), (spark.sparkContext.applicationId, sf)
    path, held = _BUNDLES.setdefault(key, (scratch(spark, "bundle"), {}))
    missing = [(k, h) for k in kinds for h in horizons if (k, h) not in held]
    with ThreadPool(8) as pool:
        fresh = pool.starmap(lambda k, h: _fit(table, k, h), missing)
    if fresh:
        bundles.save_bundle(spark, path, fresh)
        held.update({(m.name, m.horizon): m for m in fresh})
    return bundles.load_bundle(spark, path, kinds, horizons)


def _predicted(spark, sf, kinds=KINDS, horizons=HORIZONS):
    return bundles.score_bundle(_models(spark, sf, kinds, horizons), _held(spark, sf))


def _scores(predictions):
    return neat(evaluate.scores(predictions, ["model", "split", "horizon"]))


def ridge_scores(spark, sf):
    return _scores(_predicted(spark, sf, ["ridge"]))


def forest_scores(spark, sf):
    return _scores(_predicted(spark, sf, ["forest"], [0]))


def boosted_scores(spark, sf):
    return _scores(_predicted(spark, sf, ["boosted"]))


def sequence_linear_scores(spark, sf):
    return _scores(_predicted(spark, sf, ["sequence_linear"]))


def sequence_boosted_scores(spark, sf):
    return _scores(_predicted(spark, sf, ["sequence_boosted"]))


def saved_models(spark, sf):
    """Every kind at every horizon, scored from memory and from its bundle: rows, and rows that agree."""
    loaded = settled(_predicted(spark, sf))
    held = _BUNDLES[spark.sparkContext.applicationId, sf][1]
    fresh = settled(bundles.score_bundle([held[k, h] for k in KINDS for h in HORIZONS], _held(spark, sf)))
    keys = ["model", "horizon", "split", "entity_id", "year", "epi_week"]
    both = fresh.join(loaded.select(*keys, F.col("y_pred").alias("y_loaded")), keys, "full")
    return both.groupBy("model", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y_pred") == F.col("y_loaded")).alias("n_equal"))


def grid_search_results(spark, sf):
    train = _table(spark, sf).where("split = 'train'")
    _, results = models.grid_search(train, fold_ops.expanding_folds(train, n_splits=3), grid=GRID, parallelism=8)
    return neat(results)


def stacked_scores(spark, sf):
    """Forest over boosted trees, a forest and a sequence model, from five folds of the training weeks."""
    train = _table(spark, sf).where("split = 'train'")
    fitters = {
        "boosted": lambda rows: models.fit_boosted(models.compact(rows), maxIter=STACK_ROUNDS),
        "forest": lambda rows: models.fit_forest(models.compact(rows), trees=STACK_TREES),
        "sequence": lambda rows: models.fit_windows(models.compact(rows), "sequence"),
    }
    names = list(fitters)
    complete = train.dropna(subset=[*models.BOOSTED_FEATURES, "cases"])  # folds over weeks that every base can be fitted on
    base = models.out_of_fold(train, fold_ops.expanding_folds(complete, n_splits=5), fitters, parallelism=8)
    meta = models.fit_stack(settled(models.stack_frame(base, names)), names)
    held = _held(spark, sf)
    with ThreadPool(3) as pool:
        final = pool.map(lambda name: fitters[name](train), names)
    parts = [models.score_fitted(m, held, ["split"]) if isinstance(m, models.Fitted) else models.predict(m, held, name)
             for name, m in zip(names, final)]
    return _scores(models.predict(meta, models.stack_frame(combine_sources(parts), names), "stacked"))


def _all_models(spark, sf):
    parts = [persistence(_held(spark, sf)), _predicted(spark, sf, ["boosted"]), _predicted(spark, sf, ["sequence_linear"])]
    return _table(spark, sf), [settled(combine_sources(parts))]


def ensemble_scores(spark, sf):
    """All models, the same rows for each, and the routed ensemble next to them."""
    _, parts = _all_models(spark, sf)
    return neat(ensemble_report(parts, routing_table(spark, ROUTING)).by_horizon)


def walk_forward_scores(spark, sf):
    table, parts = _all_models(spark, sf)
    by_fold, _, _ = walk_forward_report(
        combine_sources(parts), table, fold_ops.block_table(spark, BLOCKS))
    return neat(by_fold)


def gain_importance(spark, sf):
    return combine_sources([importance.tree_importance(spark, m.pipeline, m.horizon) for m in _models(spark, sf, ["boosted"])])


def coefficient_importance(spark, sf):
    return importance.linear_importance(spark, _models(spark, sf, ["ridge"], [0])[0].pipeline)


def permutation_importance(spark, sf):
    return neat(importance.permutation_importance(_models(spark, sf, ["forest"], [0])[0].pipeline, _held(spark, sf)))


def _importances(spark, sf):
    """Gain, coefficients and permutation effects of the models of the bundle, in one long table."""
    held = _held(spark, sf)
    fitted = importance.fitted_importance(spark, _models(spark, sf))
    moved = [importance.permutation_importance(m.pipeline, held, m.horizon).withColumn("model", F.lit(m.name)).withColumn(
        "method", F.lit("permutation")) for m in _models(spark, sf, ["ridge", "boosted"])]
    return settled(combine_sources([fitted, *moved]), "importances")


def model_category_importance(spark, sf):
    return neat(importance.by_category(_importances(spark, sf), ["model", "method"]))


def model_category_changes(spark, sf):
    return importance.dominant_changes(_importances(spark, sf), by=["model", "method"])


def model_top_features(spark, sf):
    return neat(importance.top_features(_importances(spark, sf), by=["model", "method"]))


def _supplier_rows(spark, sf):
    """Weekly units by supplier, with last week's units and the season."""
    lagged = features_ops.add_season(features_ops.add_lags(supplier_panel(spark, sf), {"cases": "cases"}, [1, 2]))
    return settled(lagged.where("cases_lag2 is not null"), "suppliers")


def entity_coefficients(spark, sf):
    """A coefficient for each supplier, from one sparse vector."""
    rows = _supplier_rows(spark, sf)
    model = models.fit_ridge(rows, ["cases_lag1", "cases_lag2", "week_sin", "week_cos"], entity="entity_id")
    return neat(importance.entity_coefficients(spark, model))


def _counted_importance(spark, sf):
    """A stand-in importance with an SQL form: rows where feature and target exceed a bound."""
    base = base_table(spark, sf)
    names = models.BOOSTED_FEATURES
    wide = base.agg(*[
        F.count_if((F.col(f) > 0) & (F.col("cases" if h == 0 else f"target_h{h}") > h)).alias(f"{f}@{h}")
        for f in names for h in HORIZONS])
    long = wide.unpivot([], [f"`{f}@{h}`" for f in names for h in HORIZONS], "key", "hits")
    key = F.split("key", "@")
    table = settled(long.select(
        key[0].alias("feature"), key[1].cast("int").alias("horizon"), F.col("hits").cast("double").alias("importance")))
    return table.withColumn("category", importance.category_of(F.col("feature")))


def category_importance(spark, sf):
    return neat(importance.by_category(_counted_importance(spark, sf)))


def category_changes(spark, sf):
    return importance.dominant_changes(_counted_importance(spark, sf))


def top_features(spark, sf):
    return neat(importance.top_features(_counted_importance(spark, sf)))


QUERIES = {f.__name__: f for f in (
    ridge_scores, forest_scores, boosted_scores, sequence_linear_scores, sequence_boosted_scores,
    saved_models, entity_coefficients, grid_search_results, stacked_scores, ensemble_scores, walk_forward_scores, gain_importance,
    coefficient_importance, permutation_importance, model_category_importance, model_category_changes, model_top_features,
    category_importance, category_changes, top_features,
)}

_CATEGORY = "CASE " + " ".join(
    f"WHEN regexp_matches(feature, '{pattern}') THEN '{name}'" for name, pattern in importance.CATEGORIES
) + " ELSE 'Other' END AS category"
_COUNTED = {"hits": " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {h}::INT AS horizon, count(*) FILTER (WHERE {f} > 0 AND "
    f"{'cases' if h == 0 else f'target_h{h}'} > {h})::DOUBLE AS importance FROM base"
    for f in models.BOOSTED_FEATURES for h in HORIZONS),
    "named": f"SELECT *, {_CATEGORY} FROM hits",
    "rolled": """SELECT horizon, category, importance, row_number() OVER (PARTITION BY horizon
      ORDER BY importance DESC, category)::INT AS place FROM (
      SELECT horizon, category, sum(importance) AS importance FROM named GROUP BY ALL)"""}

def _complete(features):
    return " AND ".join(f"{f} IS NOT NULL" for f in features)


_FLAT = {"ridge": models.RIDGE_FEATURES, "small_forest": models.FOREST_FEATURES, "boosted": models.BOOSTED_FEATURES}
_TARGETS = ["cases", *[f"target_h{h}" for h in range(1, 5)]]
_SAVED = " UNION ALL ".join(
    [f"SELECT '{m}' AS model, {h}::INT AS horizon, count(*) AS n FROM split WHERE split <> 'train' AND {t} IS NOT NULL AND {_complete(f)}"
     for m, f in _FLAT.items() for h, t in enumerate(_TARGETS)]
    + [f"""SELECT '{m}' AS model, {h}::INT AS horizon, count(*) AS n FROM (
      SELECT {t} AS t, row_number() OVER (PARTITION BY split, entity_id ORDER BY year, epi_week) AS place FROM split WHERE split <> 'train')
      WHERE place > 12 AND t IS NOT NULL""" for m in ("sequence_linear", "sequence_boosted") for h, t in enumerate(_TARGETS)])

ORACLES = {
    "saved_models": sql(f"SELECT *, n AS n_equal FROM ({_SAVED})", "split"),
    "category_importance": sql(neat_wrap("SELECT * FROM rolled", ["importance"]), "base", extra=_COUNTED),
    "category_changes": sql("""
    SELECT a::INT AS short_horizon, b::INT AS long_horizon, s.category AS short_category, l.category AS long_category,
      s.category <> l.category AS changed FROM (VALUES (0, 4), (1, 4)) p(a, b)
    JOIN rolled s ON s.horizon = a AND s.place = 1 JOIN rolled l ON l.horizon = b AND l.place = 1""", "base", extra=_COUNTED),
    "top_features": sql(neat_wrap("""
    SELECT feature, horizon, importance, category, place, CASE WHEN contains(plain, '_lag')
      THEN replace(split_part(plain, '_lag', 1), '_', ' ') || ' (lag ' || split_part(plain, '_lag', 2) || ')'
      ELSE replace(plain, '_', ' ') END AS name
    FROM (SELECT *, replace(feature, '_norm', '') AS plain, row_number() OVER (PARTITION BY horizon
      ORDER BY importance DESC, feature)::INT AS place FROM named) WHERE place <= 10""", ["importance"]), "base", extra=_COUNTED),
}
