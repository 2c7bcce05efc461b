"""Features of a dense panel: incidence, lags, leads, neighbours, weather lags, season, scaling.

Lags count rows, which equals weeks only on a dense panel; run ``densify`` first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.measures import approximate_month, clip_low, in_season, season_phase
from weekloom.keys import DEFAULT_KEYS, Keys

# Weekly weather measures that get lags.
WEATHER_MEASURES = (
    "temp_mean", "precipitation", "humidity_mean", "heat_index_mean",
    "temp_mean_anomaly", "precipitation_anomaly", "humidity_mean_anomaly",
)
LAGS = (1, 2, 3, 4)
HORIZONS = (1, 2, 3, 4)
INCIDENCE_BASE = 10_000
# Distance from 1 to the next double.
_EPSILON = 2.0 ** -52


def add_incidence(panel: DataFrame, count: str = "cases", population: str = "population",
                  decimals: int = 4) -> DataFrame:
    """Cases per 10,000 inhabitants, rounded half to even."""
    rate = F.try_divide(F.col(count).cast("double"), F.col(population) / F.lit(INCIDENCE_BASE))
    return panel.withColumn("incidence", F.bround(rate, decimals))


def add_lags(panel: DataFrame, columns: Mapping[str, str], lags: Sequence[int] = LAGS,
             keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """``columns`` maps a column to the prefix of its lags: ``cases -> cases_lag1``."""
    order = keys.series()
    return panel.withColumns({
        f"{prefix}_lag{k}": F.lag(column, k).over(order)
        for column, prefix in columns.items() for k in lags
    })


def add_targets(panel: DataFrame, count: str = "cases", horizons: Sequence[int] = HORIZONS,
                keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Value ``h`` weeks ahead, null at the end of a series."""
    order = keys.series()
    return panel.withColumns({f"target_h{h}": F.lead(count, h).over(order) for h in horizons})


def add_neighbour_means(panel: DataFrame, edges: DataFrame, columns: Mapping[str, str],
                        lag: int = 1, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Mean over neighbouring entities (nulls skipped) some rows before.

    ``edges`` has columns ``src`` and ``dst``. Work is one row per edge and week, reduced by
    partial means before the shuffle; no pivot, so the number of entities is free. A row looks
    up the means of its earlier week, which it takes from the window all lags share, so the
    panel is not sorted again after the join.
    """
    sent = edges.select("src", F.col("dst").alias(keys.entity)).join(
        panel.select(*keys.panel, *columns), keys.entity, "inner")
    means = sent.groupBy(
        F.col("src").alias(keys.entity), F.col(keys.year).alias("_year"), F.col(keys.week).alias("_week")
    ).agg(*[F.avg(c).alias(f"{name}_lag{lag}") for c, name in columns.items()])
    order = keys.series()
    dated = panel.withColumns({
        "_year": F.lag(keys.year, lag).over(order), "_week": F.lag(keys.week, lag).over(order)})
    return dated.join(means, [keys.entity, "_year", "_week"], "left").select(
        *panel.columns, *[f"{name}_lag{lag}" for name in columns.values()])


def weather_by_week(panel: DataFrame, measures: Sequence[str] = WEATHER_MEASURES,
                    keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """One row of weather per week of a panel where weather is constant within a week."""
    return panel.groupBy(*keys.time).agg(*[F.min(m).alias(m) for m in measures])


def add_weather_lags(panel: DataFrame, measures: Sequence[str] = WEATHER_MEASURES,
                     lags: Sequence[int] = LAGS, keys: Keys = DEFAULT_KEYS,
                     weather: DataFrame | None = None) -> DataFrame:
    """Lag the weather on its own week table, then join back by week.

    The week table is bounded by the calendar: its one ordered window and its broadcast stay
    small however many entities the panel has. With ``weather`` the lags may reach back before
    the panel's first week.
    """
    weeks = weather_by_week(panel, measures, keys) if weather is None else weather
    order = Window.partitionBy().orderBy(*keys.time)
    lagged = weeks.select(*keys.time, *[
        F.lag(m, k).over(order).alias(f"{m}_lag{k}") for m in measures for k in lags])
    added = [c for c in lagged.columns if c not in keys.time]
    return panel.join(F.broadcast(lagged), keys.time, "left").select(*panel.columns, *added)


def add_season(panel: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    sine, cosine = season_phase(F.col(keys.week))
    return panel.withColumns({
        "week_sin": sine, "week_cos": cosine,
        "in_season": in_season(F.col(keys.week)),
        "month": approximate_month(F.col(keys.week)),
    })


def add_indicators(panel: DataFrame, entities: Sequence[int], focus: int | None = None,
                   keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """0/1 columns for a fixed, short list of entities, and a flag for one of interest.

    For a large domain, ``models.entity_stages`` keeps one sparse vector column in the pipeline.
    """
    columns = {f"is_entity_{e}": (F.col(keys.entity) == e).cast("int") for e in entities}
    if focus is not None:
        columns["is_focus"] = (F.col(keys.entity) == focus).cast("int")
    return panel.withColumns(columns)


def add_split(panel: DataFrame, train_until: tuple[int, int], validation_until: tuple[int, int],
              keys: Keys = DEFAULT_KEYS, embargo: int = 0) -> DataFrame:
    """Tag rows train, validation or test by week; the two bounds are inclusive.

    ``embargo`` weeks before each bound are tagged ``embargo``: their targets lie in the next
    split. With 0, training targets reach across the edge.
    """
    now = _before_or_at(train_until, keys)
    later = _before_or_at(validation_until, keys)
    split = F.when(now, "train").when(later, "validation").otherwise("test")
    if embargo:
        ahead = F.lead(F.struct(*keys.time), embargo).over(keys.series())
        for bound in (train_until, validation_until):
            edge = F.struct(F.lit(bound[0]).cast("int"), F.lit(bound[1]).cast("int"))
            inside = F.struct(F.col(keys.year).cast("int"), F.col(keys.week).cast("int")) <= edge
            split = F.when(inside & (ahead > edge), "embargo").otherwise(split)
    return panel.withColumn("split", split)


def _before_or_at(bound: tuple[int, int], keys: Keys) -> Column:
    year, week = F.col(keys.year), F.col(keys.week)
    return (year < bound[0]) | ((year == bound[0]) & (week <= bound[1]))


def split_sizes(panel: DataFrame) -> DataFrame:
    """Rows per split. ``count_if`` of a null split is zero by construction."""
    return panel.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column (null as 0): one row.

    A column whose variance is within rounding error of zero gets deviation 1.
    """
    n = F.count(F.lit(1)).cast("double")
    stats = []
    for name in columns:
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        mean, variance = F.avg(value), F.var_pop(value)
        error = n * mean * F.lit(_EPSILON)
        flat = variance <= n * F.lit(_EPSILON) * variance + error * error
        stats.append(F.struct(
            mean.alias("mean"), F.when(flat, 1.0).otherwise(F.sqrt(variance)).alias("deviation")
        ).alias(name))
    return train.agg(*stats)


def apply_scaler(rows: DataFrame, scaler: DataFrame, columns: Sequence[str],
                 suffix: str = "_norm") -> DataFrame:
    """Standardise with fitted parameters; nulls count as 0. The fit is one scalar subquery."""
    fitted = rows.withColumn("_scaler", scaler.select(F.struct(*columns)).scalar())

    def scaled(name: str) -> Column:
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        return (value - F.col(f"_scaler.{name}.mean")) / F.col(f"_scaler.{name}.deviation")

    return fitted.withColumns({f"{c}{suffix}": scaled(c) for c in columns}).drop("_scaler")


def fit_min_max(train: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Smallest and largest value per target: one row. Each horizon keeps its own scale."""
    return train.agg(*[
        F.struct(F.min(F.col(t).cast("double")).alias("low"),
                 F.max(F.col(t).cast("double")).alias("high")).alias(t) for t in targets])


def apply_min_max(rows: DataFrame, scaler: DataFrame, targets: Sequence[str],
                  suffix: str = "_scaled") -> DataFrame:
    """Map the fitted range onto 0..1, without bounds beyond it; a flat range maps to 0."""
    fitted = rows.withColumn("_scaler", scaler.select(F.struct(*targets)).scalar())
    return fitted.withColumns({
        f"{t}{suffix}": (F.col(t) - F.col(f"_scaler.{t}.low")) / _range(t) for t in targets
    }).drop("_scaler")


def invert_min_max(rows: DataFrame, scaler: DataFrame, target: str, prediction: str) -> DataFrame:
    """Bring a scaled prediction back to counts, not below 0."""
    fitted = rows.withColumn("_scaler", scaler.select(F.struct(target)).scalar())
    value = F.col(prediction) * _range(target) + F.col(f"_scaler.{target}.low")
    return fitted.withColumn(prediction, clip_low(value)).drop("_scaler")


def _range(target: str) -> Column:
    span = F.col(f"_scaler.{target}.high") - F.col(f"_scaler.{target}.low")
    return F.when(span == 0, 1.0).otherwise(span)


def sequence_windows(panel: DataFrame, features: Sequence[str], target: str, length: int = 12,
                     ahead: int = 0, by: Sequence[str] = ("split",),
                     keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """The ``length`` weeks before each row as an array of feature rows, with its target.

    Sequences restart in every ``by`` group and need ``length`` earlier rows. Features and target
    come from the same frame, so they cannot fall out of step. Null features read as 0; rows
    without a target are dropped.
    """
    order = keys.series(*by)
    step = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    value = F.col(target) if ahead == 0 else F.lead(target, ahead).over(order)
    windows = panel.select(
        *keys.panel, *by,
        F.collect_list(step).over(order.rowsBetween(-length, -1)).alias("sequence"),
        value.alias("target"))
    return windows.where((F.size("sequence") == length) & F.col("target").isNotNull())


def complete_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every named column has a value."""
    return rows.dropna(subset=list(columns))


def feature_report(features: DataFrame, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns present and their nulls per feature category, in one pass."""
    present = {c: [f for f in names if f in features.columns] for c, names in categories.items()}
    counted = features.agg(*[
        F.struct(
            F.lit(len(names)).alias("n_columns"),
            sum((F.count_if(F.col(f).isNull()) for f in names), F.lit(0)).cast("bigint").alias("n_null"),
        ).alias(category) for category, names in present.items()])
    return counted.unpivot([], list(present), "category", "_counts").select("category", "_counts.*")


def peak_incidence(panel: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """The row of highest incidence, earliest week and smallest entity on ties."""
    best = F.struct(F.col("incidence"), -F.col(keys.year), -F.col(keys.week), -F.col(keys.entity))
    return panel.where(F.col("incidence").isNotNull()).agg(
        F.max_by(F.struct(*keys.panel, "incidence"), best).alias("_peak")).select("_peak.*")
