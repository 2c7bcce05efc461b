"""Descriptive tables of a panel: totals, seasonality, shares, reports, correlations, trends."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.aggregates import correlation, intercept, share, slope
from weekloom.functions.measures import count_bucket, in_season
from weekloom.functions.significance import correlation_p_value
from weekloom.keys import DEFAULT_KEYS, Keys
from weekloom.operators.ranks import attach_rank, average_ranks, exact_quantiles

# Significance levels and their marks.
SIGNIFICANCE_MARKS = [(0.001, "***"), (0.01, "**"), (0.05, "*")]


def entity_totals(panel: DataFrame, count: str = "cases", by: Sequence[str] = (),
                  keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Total per entity (and year, if named in ``by``), largest first."""
    return panel.groupBy(keys.entity, *by).agg(F.sum(count).alias("total")).orderBy(
        F.desc("total"), keys.entity, *by)


def week_cells(panel: DataFrame, count: str = "cases", keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """The week-by-entity matrices of all years as long rows of their cells that are not 0.

    For any number of entities: a cell that is absent is 0.
    """
    cells = panel.groupBy(*keys.time, keys.entity).agg(F.sum(count).alias("total"))
    return cells.where(F.col("total") != 0)


def week_by_entity(panel: DataFrame, entities: Sequence[int], year: int | None = None, count: str = "cases",
                   keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Rows by year and week, columns by entity, empty cells 0; of one year on request.

    ``entities`` is a short list; all years come from one pass.
    """
    chosen = panel if year is None else panel.where(F.col(keys.year) == year)
    wide = chosen.groupBy(*keys.time).pivot(keys.entity, list(entities)).agg(F.sum(count))
    return wide.select(*keys.time, *[
        F.coalesce(F.col(f"`{e}`"), F.lit(0)).alias(f"entity_{e}") for e in entities])


def season_profile(panel: DataFrame, count: str = "cases", by: Sequence[str] = (),
                   keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Mean over years of the weekly total, and whether the week is in season."""
    totals = panel.groupBy(*by, *keys.time).agg(F.sum(count).alias("_total"))
    means = totals.groupBy(*by, keys.week).agg(F.avg("_total").alias("mean_total"))
    return means.withColumn("in_season", in_season(F.col(keys.week)))


def season_peak(panel: DataFrame, count: str = "cases", by: Sequence[str] = (),
                keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Week of the highest mean total, the first on ties."""
    profile = season_profile(panel, count, by, keys)
    top = F.max_by(F.struct(keys.week, "mean_total"), F.struct(F.col("mean_total"), -F.col(keys.week)))
    return profile.groupBy(*by).agg(top.alias("_top")).select(
        *by, F.col(f"_top.{keys.week}").alias("peak_week"), F.col("_top.mean_total").alias("peak_mean"))


def relative_incidence(panel: DataFrame, count: str = "cases", at_least: float | None = None,
                       keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Entity's yearly total over the mean of all entities that year.

    The yearly means are one row per year, so they are broadcast to the totals.
    """
    totals = panel.groupBy(keys.entity, keys.year).agg(F.sum(count).alias("total"))
    means = totals.groupBy(keys.year).agg(F.avg("total").alias("_mean"))
    table = totals.join(F.broadcast(means), keys.year).select(
        keys.entity, keys.year, "total", F.try_divide(F.col("total"), F.col("_mean")).alias("relative"))
    return table if at_least is None else table.where(F.col("relative") > at_least)


def focus_share(panel: DataFrame, focus: int, count: str = "cases",
                keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Percentage of each week's total that one entity contributes; null in empty weeks."""
    own = F.sum(F.when(F.col(keys.entity) == focus, F.col(count)).otherwise(0))
    weeks = panel.groupBy(*keys.time).agg(own.alias("focus_total"), F.sum(count).alias("total"))
    return weeks.withColumn("pct", F.try_divide(F.col("focus_total") * 100.0, F.col("total")))


def focus_summary(panel: DataFrame, focus: int, above: float = 50.0, count: str = "cases",
                  keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Weeks in which the focus entity holds more than ``above`` percent, and active weeks."""
    over, active = F.count_if(F.col("pct") > above), F.count_if(F.col("total") > 0)
    return focus_share(panel, focus, count, keys).agg(
        over.alias("weeks_above"), active.alias("active_weeks"),
        F.count(F.lit(1)).alias("weeks"), F.max("pct").alias("max_pct"), F.avg("pct").alias("mean_pct"),
        F.try_divide(over * 100.0, active).alias("pct_of_active"))


def with_groups(rows: DataFrame, focus: int, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Each row once as ``all`` and once as ``focus`` or ``rest``."""
    part = F.when(F.col(keys.entity) == focus, "focus").otherwise("rest")
    return rows.withColumn("group", F.explode(F.array(F.lit("all"), part)))


def zero_imbalance(panel: DataFrame, focus: int, count: str = "cases",
                   keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Percentage of zero rows and exact median of the other rows, per group."""
    grouped = with_groups(panel.select(*keys.panel, count), focus, keys)
    zeros = grouped.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), (share(F.col(count) == 0) * 100.0).alias("pct_zero"))
    medians = exact_quantiles(
        grouped.where(F.col(count) > 0), count, {"median_nonzero": 0.5}, by=["group"])
    return zeros.join(medians, "group", "left")


def panel_quality(panel: DataFrame, count: str = "cases", keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """One row: size, coverage, share of non-empty rows, total, mean and maximum."""
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(keys.entity).alias("n_entities"),
        F.count_distinct(keys.year).alias("n_years"),
        F.count_distinct(keys.week).alias("n_weeks"),
        F.count_if(F.col(count) > 0).alias("n_nonzero"),
        (share(F.col(count) > 0) * 100.0).alias("pct_nonzero"),
        F.sum(count).alias("total"), F.avg(count).alias("mean"), F.max(count).alias("max"),
    )


def year_totals(panel: DataFrame, count: str = "cases", keys: Keys = DEFAULT_KEYS) -> DataFrame:
    return panel.groupBy(keys.year).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(count).alias("total"),
        F.count_if(F.col(count) > 0).alias("n_nonzero"))


def missing_entities(panel: DataFrame, entities: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Entities of the domain without any row in the panel."""
    return entities.select(keys.entity).join(
        panel.select(keys.entity).distinct(), keys.entity, "left_anti")


def weather_quality(weeks: DataFrame) -> DataFrame:
    """One row: weeks, years, extremes, means and nulls of the weekly weather."""
    return weeks.agg(
        F.count(F.lit(1)).alias("n_weeks"), F.count_distinct("year").alias("n_years"),
        F.avg("temp_mean").alias("temp_mean"), F.max("temp_max_mean").alias("temp_max"),
        F.min("temp_min_mean").alias("temp_min"), F.avg("precipitation").alias("rain_mean"),
        F.max("precipitation").alias("rain_max"), F.avg("humidity_mean").alias("humidity_mean"),
        F.max("heat_index_mean").alias("heat_index_max"),
        F.count_if(F.col("temp_mean").isNull()).alias("n_null_temp"),
        F.count_if(F.col("precipitation").isNull()).alias("n_null_rain"))


def master_quality(master: DataFrame, count: str = "cases", keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """One row on the joined table: size, coverage, duplicates, nulls and moments.

    Duplicates come from one count per key, which also feeds every other figure.
    """
    weather = ["temp_mean", "precipitation", "humidity_mean"]
    per_key = master.groupBy(*keys.panel).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(count).alias("_total"), F.max(count).alias("_max"),
        F.count_if(F.col(count) > 0).alias("_nonzero"),
        *[F.sum(c).alias(f"_sum_{c}") for c in weather],
        *[F.count(c).alias(f"_n_{c}") for c in weather])
    return per_key.agg(
        F.sum("_n").alias("n_rows"), F.count_distinct(keys.entity).alias("n_entities"),
        F.count_distinct(keys.year).alias("n_years"), F.count_distinct(keys.week).alias("n_weeks"),
        F.sum(F.col("_n") - 1).alias("n_duplicates"), F.sum("_total").alias("total"),
        F.try_divide(F.sum("_total"), F.sum("_n")).alias("mean"), F.max("_max").alias("max"),
        F.sum("_nonzero").alias("n_nonzero"),
        *[F.try_divide(F.sum(f"_sum_{c}"), F.sum(f"_n_{c}")).alias(f"mean_{c}") for c in weather],
        *[F.sum(F.col("_n") - F.col(f"_n_{c}")).alias(f"n_null_{c}") for c in weather])


def top_weeks(panel: DataFrame, k: int = 5, count: str = "cases",
              keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """The ``k`` weeks of largest total, earlier weeks first on ties."""
    totals = panel.groupBy(*keys.time).agg(F.sum(count).alias("total"))
    return totals.orderBy(F.desc("total"), *keys.time).limit(k)


def top_rows(panel: DataFrame, k: int = 10, count: str = "cases",
             keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """The ``k`` panel rows of largest count under a total order."""
    return panel.orderBy(F.desc(count), *keys.time, keys.entity).limit(k)


def bucket_histogram(panel: DataFrame, count: str = "cases", by: Sequence[str] = ()) -> DataFrame:
    """Rows and percentage per count bucket (within ``by``)."""
    counted = panel.groupBy(*by, count_bucket(F.col(count)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))
    # One row per bucket at most, so the total per group is taken on a handful of rows.
    total = F.sum("n").over(Window.partitionBy(*by))
    return counted.withColumn("pct", F.try_divide(F.col("n") * 100.0, total))


def lagged_correlation(weeks: DataFrame, measures: Sequence[str], count: str = "total",
                       lags: Sequence[int] = (0, 1, 2, 3, 4), keys: Keys = DEFAULT_KEYS,
                       by: Sequence[str] = ()) -> DataFrame:
    """Pearson r of the count with each measure some weeks before, complete pairs only.

    ``weeks`` has one row per week (and ``by`` group), so the ordered window is bounded by the
    calendar.
    """
    order = Window.partitionBy(*by).orderBy(*keys.time)
    shifted = weeks.select(*by, count, *[
        F.lag(m, k).over(order).alias(f"{m}@{k}") for m in measures for k in lags])
    pairs = F.array(*[
        F.struct(F.lit(m).alias("variable"), F.lit(k).cast("int").alias("lag"),
                 F.col(f"`{m}@{k}`").cast("double").alias("x"))
        for m in measures for k in lags])
    long = shifted.select(*by, F.col(count).alias("_y"), F.explode(pairs).alias("_pair"))
    return long.groupBy(*by, "_pair.variable", "_pair.lag").agg(
        correlation(F.col("_y"), F.col("_pair.x")).alias("r"))


def best_lag(correlations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lag of the largest absolute r per variable, the shortest on ties."""
    known = correlations.where(F.col("r").isNotNull())
    best = F.max_by(F.struct("lag", "r"), F.struct(F.abs("r"), -F.col("lag")))
    return known.groupBy(*by, "variable").agg(best.alias("_best")).select(*by, "variable", "_best.*")


def correlation_matrix(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson r of every two columns, all from one scan.

    The pairs are rows of one short aggregate rather than hundreds of aggregate columns, and
    are reduced before the shuffle to one row per pair.
    """
    pairs = F.array(*[
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"),
                 F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for a, b in combinations(columns, 2)])
    return rows.select(F.explode(pairs).alias("_p")).groupBy("_p.first", "_p.second").agg(
        correlation(F.col("_p.x"), F.col("_p.y")).alias("r"))


def linear_trend(rows: DataFrame, measures: Sequence[str], count: str = "total") -> DataFrame:
    """Slope, intercept and r of the count on each measure."""
    fits = [F.struct(
        F.lit(m).alias("variable"), slope(F.col(count), F.col(m)).alias("slope"),
        intercept(F.col(count), F.col(m)).alias("intercept"),
        correlation(F.col(count), F.col(m)).alias("r")) for m in measures]
    return rows.agg(F.array(*fits).alias("_fits")).select(F.explode("_fits").alias("_f")).select("_f.*")


def rank_correlation(panel: DataFrame, measures: Sequence[str], focus: int, count: str = "cases",
                     keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Pearson and Spearman r per group and measure, with |rho| - |r|.

    Ranks share ties and are made per group and measure over complete pairs. The panel is
    read several times: settle a costly one first.
    """
    values = panel.select(keys.entity, F.col(count).cast("double").alias("y"),
                          *[F.col(m).cast("double").alias(m) for m in measures])
    long = values.unpivot([keys.entity, "y"], list(measures), "variable", "x").where(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    pairs = with_groups(long, focus, keys).select("group", "variable", "x", "y")
    by = ["group", "variable"]
    plain = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), correlation(F.col("x"), F.col("y")).alias("pearson"))
    x_ranks, y_ranks = average_ranks(pairs, "x", by), average_ranks(pairs, "y", by)
    # The same pair of values recurs often (empty weeks); one weighted row stands for all.
    weighted = pairs.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("w"))
    ranked = attach_rank(weighted, x_ranks, "x", by, "x_rank")
    # One row per y is left before its rank is joined, so a frequent y is no burden.
    per_y = ranked.groupBy(*by, "y").agg(F.sum(F.col("w") * F.col("x_rank")).alias("_sum"))
    off = F.col("rank") - (F.col("total") + 1) / F.lit(2.0)
    cross = per_y.join(y_ranks, [*by, "y"]).groupBy(*by).agg(
        F.sum(F.col("_sum") * off).alias("_xy"), F.sum(F.col("n") * off * off).alias("_yy"))
    spread = x_ranks.groupBy(*by).agg(F.sum(F.col("n") * off * off).alias("_xx"))
    rho = F.try_divide(F.col("_xy"), F.sqrt("_xx") * F.sqrt("_yy"))
    return plain.join(cross, by, "left").join(spread, by, "left").select(
        *by, "n", "pearson", rho.alias("spearman"),
        (F.abs(rho) - F.abs("pearson")).alias("difference"))


def with_significance(correlations: DataFrame, columns: Sequence[str] = ("pearson", "spearman"),
                      n: str = "n") -> DataFrame:
    """Two-sided p-value and mark for each coefficient of a small result table."""
    def mark(p: Column) -> Column:
        label = F.lit("ns")
        for level, stars in reversed(SIGNIFICANCE_MARKS):
            label = F.when(p < level, stars).otherwise(label)
        return F.when(p.isNotNull(), label)

    tested = correlations.withColumns({f"{c}_p": correlation_p_value(F.col(c), F.col(n)) for c in columns})
    return tested.withColumns({f"{c}_mark": mark(F.col(f"{c}_p")) for c in columns})
