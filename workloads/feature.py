"""Feature, split, scaling, sequence, augmentation and alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.functions.measures import from_log_target, log_target, outbreak_weight
from weekloom.operators import alerts, augment, features as ops
from weekloom.operators.panel import join_population, rebuild
from weekloom.plans.features import NORMALISED
from weekloom.session import settled
from workloads.base import (
    FOCUS, TRAIN_UNTIL, VALIDATION_UNTIL, base_table, edges, features, master, neat,
    neat_wrap, panel, population, sql, supplier_panel,
)

_KEY = ["entity_id", "year", "epi_week"]
_CASE_LAGS = [f"{p}_lag{k}" for p in ("cases", "incidence") for k in range(1, 5)]
_WEATHER_LAGS = [f"{m}_lag{k}" for m in ops.WEATHER_MEASURES for k in range(1, 5)]
_TARGETS = [f"target_h{h}" for h in range(1, 5)]


def incidence(spark, sf):
    rated = ops.add_incidence(join_population(master(spark, sf), population(spark, sf)))
    return neat(rated.select(*_KEY, "cases", "population", "incidence"))


def peak_incidence(spark, sf):
    return neat(ops.peak_incidence(ops.add_incidence(join_population(panel(spark, sf), population(spark, sf)))))


def case_lags(spark, sf):
    return neat(base_table(spark, sf).select(*_KEY, *_CASE_LAGS))


def targets(spark, sf):
    return neat(base_table(spark, sf).select(*_KEY, *_TARGETS))


def supplier_lags(spark, sf):
    return ops.add_targets(ops.add_lags(supplier_panel(spark, sf), {"cases": "cases"}))


def neighbour_means(spark, sf):
    return neat(ops.add_neighbour_means(
        panel(spark, sf), edges(spark, sf), {"cases": "neighbour_cases"}))


def weather_lags(spark, sf):
    return neat(base_table(spark, sf).select(*_KEY, *_WEATHER_LAGS))


def season_features(spark, sf):
    return neat(ops.add_season(panel(spark, sf)))


def entity_indicators(spark, sf):
    return ops.add_indicators(panel(spark, sf), range(25), FOCUS)


def split_sizes(spark, sf):
    return ops.split_sizes(ops.add_split(panel(spark, sf), TRAIN_UNTIL, VALIDATION_UNTIL))


def embargo_split(spark, sf):
    split = ops.add_split(panel(spark, sf), TRAIN_UNTIL, VALIDATION_UNTIL, embargo=4)
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("cases").alias("total"))


def scaled_features(spark, sf):
    columns = [f"{c}_norm" for c in NORMALISED]
    return neat(features(spark, sf).select(*_KEY, "split", *columns))


def min_max_targets(spark, sf):
    base = ops.add_split(settled(base_table(spark, sf)), TRAIN_UNTIL, VALIDATION_UNTIL)
    names = ["cases", *_TARGETS]
    fitted = ops.fit_min_max(base.where("split = 'train'"), names)
    return neat(ops.apply_min_max(base, fitted, names).select(*_KEY, *[f"{n}_scaled" for n in names]))


def min_max_inverse(spark, sf):
    split = ops.add_split(ops.add_targets(panel(spark, sf)), TRAIN_UNTIL, VALIDATION_UNTIL)
    fitted = ops.fit_min_max(split.where("split = 'train'"), ["target_h1"])
    scaled = ops.apply_min_max(split, fitted, ["target_h1"])
    shifted = scaled.withColumn("guess", F.col("target_h1_scaled") - 0.25)
    return neat(ops.invert_min_max(shifted, fitted, "target_h1", "guess").select(*_KEY, "guess"))


def sequence_windows(spark, sf):
    """Sequences, told apart by their length, first and last step and sum."""
    split = ops.add_split(supplier_panel(spark, sf), TRAIN_UNTIL, VALIDATION_UNTIL)
    windows = ops.sequence_windows(split, ["cases", "epi_week"], "cases")
    return _described(windows)


def ahead_sequences(spark, sf):
    split = ops.add_split(panel(spark, sf), TRAIN_UNTIL, VALIDATION_UNTIL)
    return _described(ops.sequence_windows(split, ["cases", "epi_week"], "cases", ahead=2))


def _described(windows):
    flat = F.flatten("sequence")
    return windows.select(
        *_KEY, "split", "target", F.size("sequence").alias("n_steps"),
        F.element_at(flat, 1).alias("first_cases"), F.element_at(flat, -1).alias("last_week"),
        F.aggregate(flat, F.lit(0.0), lambda a, b: a + b).alias("total"))


def target_transforms(spark, sf):
    cases = F.col("cases")
    return neat(supplier_panel(spark, sf).select(
        *_KEY, log_target(cases).alias("log_cases"), outbreak_weight(cases).alias("weight"),
        from_log_target(log_target(cases) - 1.0).alias("lowered")))


def complete_rows(spark, sf):
    whole = ops.complete_rows(base_table(spark, sf), [*_CASE_LAGS, *_WEATHER_LAGS, "target_h4"])
    return whole.groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"))


def rebuilt_splits(spark, sf):
    split = ops.add_split(panel(spark, sf), TRAIN_UNTIL, VALIDATION_UNTIL)
    return rebuild({s: split.where(F.col("split") == s) for s in ("train", "validation", "test")})


def feature_report(spark, sf):
    return ops.feature_report(base_table(spark, sf), {
        "cases": ["cases", "incidence", *_CASE_LAGS, *_TARGETS], "weather": list(ops.WEATHER_MEASURES),
        "weather_lags": _WEATHER_LAGS, "season": ["week_sin", "week_cos", "in_season", "month"],
        "place": ["entity_id", "is_focus", "population"]})


def _train(spark, sf):
    lagged = ops.add_targets(ops.add_lags(supplier_panel(spark, sf), {"cases": "cases"}))
    return ops.add_split(lagged, TRAIN_UNTIL, VALIDATION_UNTIL).where("split = 'train'")


def outbreak_summary(spark, sf):
    return neat(augment.outbreak_summary(_train(spark, sf)))


def worst_entities(spark, sf):
    return augment.worst_entities(_train(spark, sf))


def scaled_copies(spark, sf):
    copies = augment.scaled_copies(augment.outbreak_weeks(_train(spark, sf)))
    names = ["cases", "cases_lag1", "target_h4"]
    return copies.select(*_KEY, "factor", "is_synthetic", *[F.round(c, 4).alias(c) for c in names])


def _augmented(spark, sf):
    train = settled(_train(spark, sf))
    return augment.augmented(train, augment.scaled_copies(augment.outbreak_weeks(train)))


def augmented_rows(spark, sf):
    table = _augmented(spark, sf).groupBy("is_synthetic", "factor", "year").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("cases"), 3).alias("total"))
    return table


def augmentation_report(spark, sf):
    report = augment.augmentation_report(_augmented(spark, sf))
    return neat(report.withColumn("max", F.round("max", 4)))


def augmentation_histogram(spark, sf):
    return neat(augment.augmentation_histogram(_augmented(spark, sf)))


def alert_thresholds(spark, sf):
    return neat(alerts.fit_alert_thresholds(settled(_train(spark, sf))))


def alert_levels(spark, sf):
    levels = alerts.add_alert_level(
        supplier_panel(spark, sf), alerts.fit_alert_thresholds(settled(_train(spark, sf))))
    return levels.groupBy("year", "alert").agg(F.count(F.lit(1)).alias("n"))


def outbreak_flags(spark, sf):
    return alerts.add_outbreak_flag(panel(spark, sf))


def lead_times(spark, sf):
    flagged = alerts.add_outbreak_flag(panel(spark, sf))
    return alerts.lead_times(flagged.withColumn("is_alert", (F.col("cases") >= 4).cast("int")))


QUERIES = {f.__name__: f for f in (
    incidence, peak_incidence, case_lags, targets, supplier_lags, neighbour_means, weather_lags,
    season_features, entity_indicators, split_sizes, embargo_split, scaled_features, min_max_targets,
    min_max_inverse, sequence_windows, ahead_sequences, target_transforms, complete_rows,
    rebuilt_splits, feature_report, outbreak_summary, worst_entities, scaled_copies, augmented_rows,
    augmentation_report, augmentation_histogram, alert_thresholds, alert_levels, outbreak_flags,
    lead_times,
)}


def _split_of(source: str) -> str:
    return f"""
    SELECT *, CASE WHEN year < {TRAIN_UNTIL[0]} OR (year = {TRAIN_UNTIL[0]} AND epi_week <= {TRAIN_UNTIL[1]}) THEN 'train'
      WHEN year < {VALIDATION_UNTIL[0]} OR (year = {VALIDATION_UNTIL[0]} AND epi_week <= {VALIDATION_UNTIL[1]}) THEN 'validation'
      ELSE 'test' END AS split FROM {source}"""


_SUPPLIER_LAGS = f"""
    SELECT *, {', '.join(f'lag(cases, {k}) OVER w AS cases_lag{k}' for k in range(1, 5))},
      {', '.join(f'lead(cases, {h}) OVER w AS target_h{h}' for h in range(1, 5))}
    FROM supplier_panel WINDOW w AS (PARTITION BY entity_id ORDER BY year, epi_week)"""
_TRAIN = {"lagged": _SUPPLIER_LAGS, "tagged": _split_of("lagged"),
          "training": "SELECT * FROM tagged WHERE split = 'train'"}


def _noise(name: str) -> str:
    digest = f"md5(entity_id || '|' || year || '|' || epi_week || '|' || factor::INT || '|{name}')"
    def uniform(start: int) -> str:
        return f"((('0x' || substr({digest}, {start}, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)"
    return f"(sqrt(-2.0::DOUBLE * ln({uniform(1)})) * cos(2.0::DOUBLE * pi() * {uniform(13)}))"


def _copy(name: str) -> str:
    value = f"(coalesce({name}, 0)::DOUBLE * factor)"
    return f"greatest(0.0, {value} + {_noise(name)} * (abs({value}) * 0.05::DOUBLE + 0.000001::DOUBLE)) AS {name}"


_COPIED = ["cases", "cases_lag1", "target_h4"]
_COPIES = f"""
    SELECT entity_id, year, epi_week, factor, true AS is_synthetic, {', '.join(_copy(c) for c in _COPIED)}
    FROM training CROSS JOIN (SELECT unnest([2.0::DOUBLE, 3.0::DOUBLE]) AS factor) WHERE cases > 50"""
_BOTH = """
    SELECT entity_id, year, epi_week, 1.0::DOUBLE AS factor, false AS is_synthetic, cases::DOUBLE AS cases FROM training
    UNION ALL SELECT entity_id, year, epi_week, factor, is_synthetic, cases FROM copies"""
_AUGMENTED = {**_TRAIN, "copies": _COPIES, "both_rows": _BOTH}
_SEQUENCE = """
    SELECT entity_id, year, epi_week, split, {target} AS target, n::INT AS n_steps, first_cases, last_week, total FROM (
      SELECT *, count(*) OVER f AS n, first_value(cases::DOUBLE) OVER f AS first_cases,
        last_value(epi_week::DOUBLE) OVER f AS last_week, sum(cases::DOUBLE + epi_week) OVER f AS total,
        lead(cases, 2) OVER (PARTITION BY entity_id, split ORDER BY year, epi_week) AS ahead
      FROM tagged WINDOW f AS (PARTITION BY entity_id, split ORDER BY year, epi_week ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
    WHERE n = 12 AND {target} IS NOT NULL"""
_SCALED_NAMES = ["cases", *_TARGETS]
_BUCKET = """CASE WHEN cases > 500 THEN '> 500' WHEN cases > 200 THEN '201-500'
      WHEN cases > 50 THEN '51-200' WHEN cases > 0 THEN '1-50' WHEN cases = 0 THEN '= 0' END"""
_ALERTS = """
    SELECT quantile_cont(cases, 0.5) AS low, quantile_cont(cases, 0.75) AS moderate,
      quantile_cont(cases, 0.9) AS high, quantile_cont(cases, 0.95) AS critical FROM training"""


def _norm(name: str) -> str:
    return (f"(coalesce({name}, 0)::DOUBLE - m_{name}) / CASE WHEN lo_{name} = hi_{name} OR s_{name} = 0 THEN 1 ELSE s_{name} END "
            f"AS {name}_norm")


def _counted_nulls(name: str, columns: list[str]) -> str:
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in columns)
    return f"SELECT '{name}' AS category, {len(columns)}::INT AS n_columns, ({nulls})::BIGINT AS n_null FROM base"


ORACLES = {
    "incidence": sql(neat_wrap("SELECT entity_id, year, epi_week, cases, population, incidence FROM rated",
                               ["cases", "incidence"]), "rated"),
    "peak_incidence": sql(neat_wrap("""
    SELECT entity_id, year, epi_week, round_even(cases / (population / 10000), 4) AS incidence
    FROM panel JOIN pop USING (entity_id) ORDER BY 4 DESC, year, epi_week, entity_id LIMIT 1""", ["incidence"]),
                          "panel", "pop"),
    "case_lags": sql(neat_wrap(f"SELECT {', '.join(_KEY + _CASE_LAGS)} FROM moved", _CASE_LAGS), "moved"),
    "targets": sql(neat_wrap(f"SELECT {', '.join(_KEY + _TARGETS)} FROM moved", _TARGETS), "moved"),
    "supplier_lags": sql("SELECT * FROM lagged", "supplier_panel", extra={"lagged": _SUPPLIER_LAGS}),
    "neighbour_means": sql(neat_wrap("""
    SELECT p.*, lag(m, 1) OVER (PARTITION BY p.entity_id ORDER BY p.year, p.epi_week) AS neighbour_cases_lag1
    FROM panel p LEFT JOIN (SELECT src, year, epi_week, avg(cases) AS m FROM edges JOIN panel ON dst = entity_id GROUP BY ALL) n
      ON p.entity_id = n.src AND p.year = n.year AND p.epi_week = n.epi_week""", ["neighbour_cases_lag1"]), "panel", "edges"),
    "weather_lags": sql(neat_wrap(f"SELECT {', '.join(_KEY + _WEATHER_LAGS)} FROM base", _WEATHER_LAGS), "base"),
    "season_features": sql(neat_wrap("""
    SELECT *, sin(2.0 * pi() * epi_week / 52) AS week_sin, cos(2.0 * pi() * epi_week / 52) AS week_cos,
      CASE WHEN epi_week <= 17 OR epi_week >= 48 THEN 1 ELSE 0 END AS in_season,
      least(greatest((epi_week - 1) // 4 + 1, 1), 12)::INT AS month FROM panel""", ["week_sin", "week_cos"]), "panel"),
    "entity_indicators": sql("SELECT *, " + ", ".join(
        f"(entity_id = {e})::INT AS is_entity_{e}" for e in range(25)) + f", (entity_id = {FOCUS})::INT AS is_focus FROM panel", "panel"),
    "split_sizes": sql("SELECT split, count(*)::BIGINT AS n_rows FROM tagged GROUP BY 1", "panel",
                       extra={"tagged": _split_of("panel")}),
    "embargo_split": sql("""
    SELECT CASE WHEN split <> lead4 AND split IN ('train', 'validation') THEN 'embargo' ELSE split END AS split,
      count(*)::BIGINT AS n_rows, sum(cases)::BIGINT AS total
    FROM (SELECT *, coalesce(lead(split, 4) OVER (PARTITION BY entity_id ORDER BY year, epi_week), split) AS lead4 FROM tagged)
    GROUP BY 1""", "panel", extra={"tagged": _split_of("panel")}),
    "scaled_features": sql(neat_wrap(
        f"SELECT entity_id, year, epi_week, split, {', '.join(_norm(c) for c in NORMALISED)} FROM split CROSS JOIN fitted",
        [f"{c}_norm" for c in NORMALISED]), "split", extra={"fitted": "SELECT " + ", ".join(
            f"avg(coalesce({c}, 0)::DOUBLE) AS m_{c}, stddev_pop(coalesce({c}, 0)::DOUBLE) AS s_{c}, "
            f"min(coalesce({c}, 0)) AS lo_{c}, max(coalesce({c}, 0)) AS hi_{c}" for c in NORMALISED)
            + " FROM split WHERE split = 'train'"}),
    "min_max_targets": sql(neat_wrap("SELECT entity_id, year, epi_week, " + ", ".join(
        f"({c} - lo_{c}) / CASE WHEN hi_{c} = lo_{c} THEN 1 ELSE hi_{c} - lo_{c} END AS {c}_scaled" for c in _SCALED_NAMES)
        + " FROM split CROSS JOIN fitted", [f"{c}_scaled" for c in _SCALED_NAMES]), "split",
        extra={"fitted": "SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _SCALED_NAMES)
               + " FROM split WHERE split = 'train'"}),
    "min_max_inverse": sql(neat_wrap("""
    SELECT entity_id, year, epi_week, CASE WHEN target_h1 IS NOT NULL THEN
      greatest(0.0, ((target_h1 - lo)::DOUBLE / (hi - lo) - 0.25::DOUBLE) * (hi - lo) + lo) END AS guess
    FROM tagged CROSS JOIN (SELECT min(target_h1)::DOUBLE AS lo, max(target_h1)::DOUBLE AS hi FROM tagged WHERE split = 'train')""",
                                     ["guess"]), "panel", extra={
        "ahead": "SELECT *, lead(cases, 1) OVER (PARTITION BY entity_id ORDER BY year, epi_week) AS target_h1 FROM panel",
        "tagged": _split_of("ahead")}),
    "sequence_windows": sql(_SEQUENCE.format(target="cases"), "supplier_panel", extra={"tagged": _split_of("supplier_panel")}),
    "ahead_sequences": sql(_SEQUENCE.format(target="ahead"), "panel", extra={"tagged": _split_of("panel")}),
    "target_transforms": sql(neat_wrap("""
    SELECT entity_id, year, epi_week, ln(1 + cases::DOUBLE) AS log_cases, ln(1 + cases::DOUBLE) + 1 AS weight,
      exp(greatest(ln(1 + cases::DOUBLE) - 1, 0)) - 1 AS lowered FROM supplier_panel""",
                                       ["log_cases", "weight", "lowered"]), "supplier_panel"),
    "complete_rows": sql("SELECT year, count(*)::BIGINT AS n_rows FROM base WHERE "
                         + " AND ".join(f"{c} IS NOT NULL" for c in [*_CASE_LAGS, *_WEATHER_LAGS, "target_h4"])
                         + " GROUP BY 1", "base"),
    "rebuilt_splits": sql("SELECT * FROM tagged", "panel", extra={"tagged": _split_of("panel")}),
    "feature_report": sql(" UNION ALL ".join(_counted_nulls(n, c) for n, c in {
        "cases": ["cases", "incidence", *_CASE_LAGS, *_TARGETS], "weather": list(ops.WEATHER_MEASURES),
        "weather_lags": _WEATHER_LAGS, "season": ["week_sin", "week_cos", "in_season", "month"],
        "place": ["entity_id", "is_focus", "population"]}.items()), "base"),
    "outbreak_summary": sql(neat_wrap("""
    SELECT count(*) FILTER (WHERE cases > 50)::BIGINT AS n_outbreak, count(*)::BIGINT AS n,
      count(*) FILTER (WHERE cases > 50) * 100.0 / count(*) AS pct, avg(cases) FILTER (WHERE cases > 50) AS mean,
      max(cases) FILTER (WHERE cases > 50) AS max FROM training""", ["pct", "mean"]), "supplier_panel", extra=_TRAIN),
    "worst_entities": sql("""
    SELECT entity_id, max(cases) AS peak FROM training WHERE cases > 50 GROUP BY 1 ORDER BY peak DESC, entity_id LIMIT 3""",
                          "supplier_panel", extra=_TRAIN),
    "scaled_copies": sql("SELECT entity_id, year, epi_week, factor, is_synthetic, "
                         + ", ".join(f"round({c}, 4) AS {c}" for c in _COPIED) + " FROM copies",
                         "supplier_panel", extra={**_TRAIN, "copies": _COPIES}),
    "augmented_rows": sql("""
    SELECT is_synthetic, factor, year, count(*)::BIGINT AS n, round(sum(cases), 3) AS total FROM both_rows GROUP BY ALL""",
                          "supplier_panel", extra=_AUGMENTED),
    "augmentation_report": sql(neat_wrap("""
    SELECT is_synthetic, count(*)::BIGINT AS n, count(*) FILTER (WHERE cases = 0) * 100.0 / count(*) AS pct_zero,
      count(*) FILTER (WHERE cases > 50)::BIGINT AS n_outbreak,
      count(*) FILTER (WHERE cases > 50) * 100.0 / count(*) AS pct_outbreak, round(max(cases), 4) AS max
    FROM both_rows GROUP BY 1""", ["pct_zero", "pct_outbreak", "max"]), "supplier_panel", extra=_AUGMENTED),
    "augmentation_histogram": sql(neat_wrap(f"""
    SELECT is_synthetic, bucket, n, n * 100.0 / sum(n) OVER (PARTITION BY is_synthetic) AS pct FROM (
      SELECT is_synthetic, {_BUCKET} AS bucket, count(*)::BIGINT AS n FROM both_rows GROUP BY ALL)""", ["pct"]),
                                  "supplier_panel", extra=_AUGMENTED),
    "alert_thresholds": sql(neat_wrap(_ALERTS, ["low", "moderate", "high", "critical"]), "supplier_panel", extra=_TRAIN),
    "alert_levels": sql(f"""
    SELECT year, CASE WHEN cases >= critical THEN 'critical' WHEN cases >= high THEN 'high'
      WHEN cases >= moderate THEN 'moderate' WHEN cases >= low THEN 'low' ELSE 'none' END AS alert, count(*)::BIGINT AS n
    FROM supplier_panel CROSS JOIN ({_ALERTS}) GROUP BY ALL""", "supplier_panel", extra=_TRAIN),
    "outbreak_flags": sql("SELECT *, (cases >= 5)::INT AS is_outbreak FROM panel", "panel"),
    "lead_times": sql("""
    SELECT entity_id, episode::BIGINT AS episode, onset_year, onset_week,
      CASE WHEN alert <= onset THEN (onset - alert)::INT END AS lead_weeks FROM (
      SELECT entity_id, episode, min(CASE WHEN cases >= 4 THEN no END) AS alert,
        min(CASE WHEN cases >= 5 THEN no END) AS onset,
        arg_min(year, no) FILTER (WHERE cases >= 5) AS onset_year,
        arg_min(epi_week, no) FILTER (WHERE cases >= 5) AS onset_week
      FROM (SELECT *, sum(cut) OVER (PARTITION BY entity_id ORDER BY no ROWS UNBOUNDED PRECEDING) + 1 AS episode FROM (
        SELECT *, CASE WHEN lag(cases) OVER w >= 5 AND cases < 5 THEN 1 ELSE 0 END AS cut, row_number() OVER w AS no
        FROM panel WINDOW w AS (PARTITION BY entity_id ORDER BY year, epi_week)))
      GROUP BY ALL) WHERE onset IS NOT NULL""", "panel"),
}
