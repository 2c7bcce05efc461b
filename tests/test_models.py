import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.operators import folds, importance, models
from weekloom.operators.features import sequence_windows
from weekloom.sources import bundles

SCHEMA = "entity_id int, year int, epi_week int, split string, cases double, a double, b double, c double"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    data = []
    for e in range(4):
        for w in range(1, 53):
            a, b, c = rng.normal(size=3)
            data.append((e, 2023, w, "train" if w <= 40 else "test", float(max(0.0, 10 + 4 * a - b)), float(a), float(b), float(c)))
    return spark.createDataFrame(data, SCHEMA).cache()


def test_ridge_is_the_closed_form(table):
    train = table.where("split = 'train'")
    fitted = models.fit_ridge(train, ["a", "b", "c"], alpha=5.0)
    pdf = train.toPandas()
    x = pdf[["a", "b", "c"]].to_numpy()
    mean, deviation = x.mean(0), x.std(0)
    z, y = (x - mean) / deviation, pdf["cases"].to_numpy()
    w = np.linalg.solve(z.T @ z + 5.0 * np.eye(3), z.T @ (y - y.mean()))
    held = table.where("split = 'test'").toPandas()
    want = np.maximum((held[["a", "b", "c"]].to_numpy() - mean) / deviation @ w + y.mean(), 0)
    got = models.predict(fitted, table.where("split = 'test'"), "ridge").toPandas()
    both = held.merge(got, on=["entity_id", "year", "epi_week"])
    order = held.merge(both[["entity_id", "epi_week", "y_pred"]], on=["entity_id", "epi_week"])
    assert np.allclose(order["y_pred"], want, atol=1e-6)


def test_missing_feature_raises(table):
    with pytest.raises(ValueError, match="features not in the table"):
        models.fit_forest(table, ["a", "nope"])


def test_trees_learn_and_survive_the_disk(table, tmp_path):
    train, held = table.where("split = 'train'"), table.where("split = 'test'")
    boosted = models.fit_boosted(train.where("epi_week <= 30"), ["a", "b", "c"], validation=train.where("epi_week > 30"), maxIter=20)
    boosted.write().overwrite().save(str(tmp_path / "m"))
    loaded = type(boosted).load(str(tmp_path / "m"))
    scored = models.predict(loaded, held, "boosted").agg(
        F.avg(F.abs(F.col("y_real") - F.col("y_pred"))), F.avg(F.abs(F.col("y_real") - 10))).first()
    assert scored[0] < 0.6 * scored[1] and models.model_features(loaded) == ["a", "b", "c"]


def test_grid_search_picks_the_lower_error(table):
    grid = {"maxIter": [1, 15], "maxDepth": [3]}
    train = table.where("split = 'train'")
    best, results = models.grid_search(train, folds.expanding_folds(train, 2, min_train=10), ["a", "b", "c"], grid=grid)
    assert best["maxIter"] == 15 and results.count() == 4


def test_sequences_and_stack(table):
    rows = models.sequence_rows(table, ["a", "cases"], length=3)
    assert rows.count() == 4 * (40 - 3) + 4 * (12 - 3)
    for kind, params in (("linear", {"maxIter": 10}), ("boosted", {"maxIter": 3})):
        fitted = models.fit_sequence(rows.where("split = 'train'"), kind, **params)
        got = models.predict_sequence(fitted, rows.where("split = 'test'"), kind, 3)
        assert got.count() == 36 and got.where("y_pred < 0").count() == 0
    train = table.where("split = 'train'")
    fitters = {"forest": lambda part: models.fit_forest(part, ["a", "b"], trees=3, depth=3),
               "ridge": lambda part: models.fit_ridge(part, ["a", "b"])}
    base = models.stack_frame(models.out_of_fold(train, folds.expanding_folds(train, 2, 10), fitters), list(fitters))
    assert base.count() == 4 * 26 and models.fit_stack(base, list(fitters), trees=3).stages


def test_importance(spark, table):
    model = models.fit_forest(table, ["a", "b", "c"], trees=10, depth=4)
    gain = {r["feature"]: r["importance"] for r in importance.tree_importance(spark, model, 0).collect()}
    assert sum(gain.values()) == pytest.approx(100, abs=0.01) and gain["a"] > gain["b"] > gain["c"]
    ridge = {r["feature"]: r["importance"] for r in importance.linear_importance(spark, models.fit_ridge(table, ["a", "b", "c"])).collect()}
    assert ridge["a"] > ridge["b"] > ridge["c"]
    for buckets in (1, 16):
        moved = {r["feature"]: r["importance"] for r in importance.permutation_importance(model, table, buckets=buckets).collect()}
        assert set(moved) == {"a", "b", "c"} and moved["a"] > 80


def test_permutation_of_an_unused_feature_is_zero(spark):
    data = [(1, 2023, w, float(w % 7), float(w % 7), 1.0) for w in range(60)]
    frame = spark.createDataFrame(data, "entity_id int, year int, epi_week int, cases double, a double, flat double")
    model = models.fit_forest(frame, ["a", "flat"], trees=5, depth=4)
    got = {r["feature"]: r["importance"] for r in importance.permutation_importance(model, frame, buckets=4).collect()}
    assert got == {"a": 100.0, "flat": 0.0}


def test_permutation_moves_rows_once(table):
    model = models.fit_ridge(table, ["a", "b", "c"])
    plan = importance.permutation_importance(model, table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(bucket") == 1


def test_categories(spark, rows):
    names = ["cases_lag2_norm", "neighbour_cases_lag1", "temp_mean_anomaly_lag3", "precipitation", "heat_index_mean_lag1",
             "week_sin", "population", "temp_max_mean"]
    frame = spark.createDataFrame([(n, float(i + 1), h) for h in (0, 4) for i, n in enumerate(names)], "feature string, importance double, horizon int")
    table = frame.withColumn("category", importance.category_of(F.col("feature")))
    assert [r["category"] for r in table.where("horizon = 0").orderBy("importance").collect()] == [
        "Own cases", "Neighbourhood", "Temperature", "Precipitation", "Humidity and heat", "Season", "Place", "Other"]
    assert rows(importance.top_categories(table, 1), "horizon", "category") == [(0, "Other"), (4, "Other")]
    assert rows(importance.dominant_changes(table)) == [(0, 4, "Other", "Other", False)]
    assert [r["name"] for r in importance.top_features(table.where("horizon = 0"), 8).orderBy("importance").collect()][:3] == [
        "cases (lag 2)", "neighbour cases (lag 1)", "temp mean anomaly (lag 3)"]


def test_first_rounds_are_a_fit_with_fewer_rounds(table):
    train, held = table.where("split = 'train'"), table.where("split = 'test'")
    for setting in ({"maxDepth": 3}, {"maxDepth": 2, "subsamplingRate": 0.8, "stepSize": 0.3}):
        whole = models.fit_boosted(train, ["a", "b", "c"], maxIter=9, **setting)
        for rounds in (1, 4, 9):
            apart = models.fit_boosted(train, ["a", "b", "c"], maxIter=rounds, **setting)
            want = models.predict(apart, held, "m").orderBy("entity_id", "epi_week").toPandas()
            got = models.predict(models.staged(whole, rounds), held, "m").orderBy("entity_id", "epi_week").toPandas()
            assert np.allclose(got["y_pred"], want["y_pred"], rtol=0, atol=1e-12)


def test_grid_scores_every_setting_from_shared_fits(table):
    grid = {"maxIter": [1, 3, 6], "maxDepth": [2, 3]}
    train = table.where("split = 'train'")
    parts = folds.expanding_folds(train, 2, min_train=10)
    _, results = models.grid_search(train, parts, ["a", "b", "c"], grid=grid)
    assert results.count() == 12
    rows = folds.assign_folds(train, parts).where("fold = 2")
    alone = models.fit_boosted(rows.where("role = 'train'"), ["a", "b", "c"], maxIter=3, maxDepth=3)
    mae = models.predict(alone, rows.where("role = 'validation'"), "m").agg(F.avg(F.abs(F.col("y_real") - F.col("y_pred")))).first()[0]
    assert results.where("fold = 2 and params = 'maxIter=3, maxDepth=3'").first()["mae"] == pytest.approx(mae, abs=1e-12)


def test_sequence_fit_keeps_its_scale_and_stops(table):
    """A target a thousand times as large gives predictions a thousand times as large."""
    rows = models.sequence_rows(table, ["a", "cases"], length=3)
    large = rows.withColumn("target", F.col("target") * 1000)
    key = ["entity_id", "epi_week"]
    small_fit, large_fit = (models.fit_sequence(r, maxIter=40, regParam=0.0) for r in (rows, large))
    small = models.predict_sequence(small_fit, rows, "m").orderBy(*key).toPandas()["y_pred"]
    assert np.allclose(models.predict_sequence(large_fit, large, "m").orderBy(*key).toPandas()["y_pred"], 1000 * small, rtol=1e-6, atol=1e-6)
    noise = rows.withColumn("target", F.abs(F.hash("entity_id", "epi_week") % 50).cast("double"))
    stopped = models.fit_sequence(noise, "boosted", maxIter=40)
    assert models.regressor_of(stopped).getNumTrees < 40
    assert models.doublings(100) == [13, 25, 50, 100] and models.doublings(5) == [5]


def test_stack_windows_never_read_ahead(table):
    """Out of fold, windows hold weeks before their own alone, and no training target lies in the fold."""
    seen = []

    def sequence(part):
        seen.append(part.agg(F.max("epi_week")).first()[0])
        return models.fit_windows(part, "sequence", 2, features=["a_norm", "week"], length=3, maxIter=5)

    train = table.withColumn("week", F.col("epi_week").cast("double")).withColumn(
        "target_h2", F.lead("cases", 2).over(models.Window.partitionBy("entity_id").orderBy("epi_week"))).where("split = 'train'")
    parts = folds.expanding_folds(train, 2, min_train=10)
    starts = {r.fold: r.start for r in parts.where("role = 'validation'").groupBy("fold").agg(F.min("epi_week").alias("start")).collect()}
    fitters = {"sequence": sequence, "ridge": lambda part: models.fit_ridge(part, ["a", "b"], "target_h2")}
    got = models.out_of_fold(train, parts, fitters, 2, parallelism=1)
    assert sorted(seen) == sorted(start - 3 for start in starts.values())  # the last target is of the week before the fold
    weeks = [r.epi_week for r in parts.where("role = 'validation'").select("epi_week").distinct().collect()]
    assert got.groupBy("model").count().orderBy("model").collect() == [("ridge", 4 * len(weeks)), ("sequence", 4 * len(weeks))]
    windows = sequence_windows(train, ["week"], "target_h2", 3, 0, ())
    assert windows.where(F.array_max(F.transform("sequence", lambda s: s[0])) >= F.col("epi_week")).count() == 0
    assert models.stack_frame(got, list(fitters)).count() == 4 * len(weeks)


def test_bundle_round_trip_and_its_checks(spark, table, tmp_path, rows):
    train, path = table.where("split = 'train'"), str(tmp_path / "bundle")
    fitted = [models.fit_flat(models.fit_ridge, train, "ridge", features=["a", "b"]),
              models.fit_flat(models.fit_boosted, train, "boosted", features=["a", "c"], maxIter=3),
              models.fit_windows(train, "linear", features=["a_norm", "b"], length=3, maxIter=5),
              models.fit_windows(train, "trees", kind="boosted", features=["a_norm", "b"], length=2, maxIter=2)]
    bundles.save_bundle(spark, path, fitted[:2])
    bundles.save_bundle(spark, path, fitted[1:])  # replaces one, adds two
    loaded = bundles.load_bundle(spark, path)
    assert [m.name for m in loaded] == ["boosted", "linear", "ridge", "trees"]
    assert [m.name for m in bundles.load_bundle(spark, path, ["linear"], [0])] == ["linear"]
    held = table.where("split = 'test'").drop("c").withColumn("c", F.lit(1.0))  # no training row, no scaler is needed
    assert rows(bundles.score_bundle(loaded, held)) == rows(bundles.score_bundle(fitted, held))
    with pytest.raises(ValueError, match="features not in the table"):
        bundles.score_bundle(loaded, held.drop("b"))
    for name, change in (("ridge", {"features": ["a", "c"]}), ("linear", {"length": 4}), ("trees", {"scaler": []})):
        file = next((Path(path) / "manifest" / f"name={name}" / "horizon=0").glob("*.json"))
        entry = json.loads(file.read_text())
        for crc in file.parent.glob("*.crc"):
            crc.unlink()
        for crc in file.parent.glob(".*.crc"):
            crc.unlink()
        file.write_text(json.dumps(entry | change))
        with pytest.raises(ValueError, match=f"{name} at horizon 0"):
            bundles.load_bundle(spark, path, [name])


def test_importance_by_model(spark, table, rows):
    fitted = [models.fit_flat(models.fit_ridge, table, "ridge", features=["a", "b", "c"]),
              models.fit_windows(table, "linear", features=["a", "cases"], length=2, maxIter=5),
              models.fit_flat(models.fit_forest, table, "forest", features=["a", "b"], trees=3)]
    long = importance.fitted_importance(spark, fitted)
    assert rows(long.groupBy("model", "method").agg(F.count("*"), F.round(F.sum("importance"), 1))) == [
        ("forest", "gain", 2, 100.0), ("linear", "coefficient", 2, 100.0), ("ridge", "coefficient", 3, 100.0)]
    by = importance.by_category(long, ["model", "method"])
    assert rows(by.groupBy("model").agg(F.round(F.sum("importance"), 1))) == [("forest", 100.0), ("linear", 100.0), ("ridge", 100.0)]
    assert importance.top_features(long, 1, ["model"]).count() == 3
    assert importance.dominant_changes(long, ((0, 0),), ["model"]).count() == 3


def test_entities_of_any_number_have_coefficients(spark, table, tmp_path, rows):
    """One sparse vector: the closed form of a ridge, saved with its domain, unseen entities kept."""
    train = table.where("split = 'train'").withColumn("cases", F.col("cases") + 3 * F.col("entity_id"))
    model = models.fit_ridge(train, ["a", "b"], alpha=2.0, entity="entity_id")
    pdf = train.toPandas()
    x = pdf[["a", "b"]].to_numpy()
    dummies = np.eye(4)[pdf["entity_id"]]
    z = np.hstack([(x - x.mean(0)) / x.std(0, ddof=1), dummies])
    zc, y = z - z.mean(0), pdf["cases"].to_numpy()
    w = np.linalg.solve(zc.T @ zc + 2.0 * np.eye(6), zc.T @ (y - y.mean()))
    got = importance.entity_coefficients(spark, model).orderBy("entity").collect()
    assert [r.entity for r in got] == ["0", "1", "2", "3"] and np.allclose([r.coefficient for r in got], w[2:], atol=1e-4)
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = type(model).load(str(tmp_path / "m"))
    assert models.model_features(loaded) == ["a", "b"] and models.entity_domain(loaded) == ["0", "1", "2", "3"]
    unseen = train.where("entity_id = 1").withColumn("entity_id", F.lit(99))
    both = models.predict(loaded, unseen, "m"), models.predict(loaded, train.where("entity_id = 1"), "m")
    mean = [p.agg(F.avg("y_pred")).first()[0] for p in both]
    assert both[0].count() == 40 and mean[1] - mean[0] == pytest.approx(got[1].coefficient, abs=1e-6)
    forest = models.fit_forest(train, ["a"], trees=5, depth=4, entity="entity_id")
    assert models.predict(forest, unseen, "f").count() == 40 and models.entity_domain(models.fit_ridge(train, ["a"])) == []
