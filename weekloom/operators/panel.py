"""From source rows to a dense weekly panel, and the joins that widen it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.calendar import week_index, week_of_index, year_of_index
from weekloom.keys import DEFAULT_KEYS, Keys
from weekloom.session import dealt


def combine_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda left, right: left.unionByName(right), sources)


def source_summary(rows: DataFrame, count: str = "cases", source: str = "source",
                   year: str = "year") -> DataFrame:
    """Rows, cases and distinct years per source."""
    return rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(count).alias("total"),
        F.sort_array(F.collect_set(year)).alias("years"),
    )


def weekly_sum(rows: DataFrame, measures: Mapping[str, Column] | Sequence[str] = ("cases",),
               keys: Keys = DEFAULT_KEYS, by: Sequence[str] = ()) -> DataFrame:
    """Sum measures per entity and week. Partial sums are taken before the shuffle."""
    named = measures if isinstance(measures, Mapping) else {m: F.col(m) for m in measures}
    return rows.groupBy(*keys.panel, *by).agg(*[F.sum(c).alias(m) for m, c in named.items()])


def resolve_overlap(by_source: DataFrame, order: Sequence[str], measures: Sequence[str] = ("cases",),
                    keys: Keys = DEFAULT_KEYS, source: str = "source") -> DataFrame:
    """Where several sources cover a panel key, take the first source in ``order``.

    Without this step overlapping sources add up. ``by_source`` has one row per key and source.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(source))
    last = F.when(rank == 0, F.lit(len(order) + 1)).otherwise(rank)
    best = F.min_by(F.struct(*measures, source), F.struct(last.alias("rank"), F.col(source)))
    return by_source.groupBy(*keys.panel).agg(best.alias("_best")).select(*keys.panel, "_best.*")


def densify(panel: DataFrame, measures: Sequence[str] = ("cases",), keys: Keys = DEFAULT_KEYS,
            entities: DataFrame | None = None, weeks_per_year: int | None = None,
            observed_years_only: bool = True) -> DataFrame:
    """Add the missing weeks of every entity with zero measures.

    The calendar covers all weeks of the years seen in the panel: ISO weeks, or weeks
    1..``weeks_per_year`` (a week beyond that is dropped, as with a 52-week calendar).
    Each row fills the weeks up to the entity's next row, so no grid is built and joined: one
    exchange on the entity serves this step and the lag features after it. ``entities`` names
    entities that must be present although they may have no rows at all.

    Rows of one entity and week add up. Rows without a year or week belong to no week and drop;
    ``rows_without_week`` counts them and what they hold.
    """
    panel = panel.where(F.col(keys.year).isNotNull() & F.col(keys.week).isNotNull())
    if weeks_per_year is not None:
        panel = panel.where(F.col(keys.week) <= weeks_per_year)
    # Bounded by the number of years. The filter keeps the measure in this branch, so that it
    # reads the same exchange as the rows below instead of scanning the source again.
    counted = panel.where(F.coalesce(*[F.col(m).cast("double") for m in measures]).isNotNull())
    years = counted.agg(F.sort_array(F.collect_set(keys.year)).alias("years")).scalar()
    at = week_index(keys.year, keys.week, weeks_per_year)
    rows = panel.select(
        keys.entity, at.alias("_at"), F.lit(1).alias("_real"),
        *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures])
    if entities is not None:
        rows = rows.unionByName(
            entities.select(keys.entity).distinct()
            .withColumns({"_at": F.lit(None).cast("int"), "_real": F.lit(0)}),
            allowMissingColumns=True)
    bounded = rows.withColumn("_years", years).withColumns({
        "_first": week_index(F.element_at("_years", 1), F.lit(1), weeks_per_year),
        "_end": week_index(F.element_at("_years", -1) + 1, F.lit(1), weeks_per_year),
    })
    # The one exchange on the entity: its partitions grow with the input.
    placed = dealt(bounded.withColumn("_at", F.coalesce("_at", "_first")), keys.entity)
    order = Window.partitionBy(keys.entity).orderBy("_at", "_real")
    same = Window.partitionBy(keys.entity).orderBy("_at").rangeBetween(0, 0)
    placed = placed.withColumns({m: F.sum(F.coalesce(m, F.lit(0))).over(same) for m in measures})
    begin = F.when(F.lag("_at").over(order).isNull(), F.col("_first")).otherwise(F.col("_at"))
    stop = F.coalesce(F.lead("_at").over(order), F.col("_end")) - 1
    spans = placed.withColumns({"_begin": begin, "_stop": stop})
    weeks = spans.where(F.col("_begin") <= F.col("_stop")).select(
        keys.entity, "_at", "_real", "_years", *measures,
        F.explode(F.sequence("_begin", "_stop")).alias("_week"))
    own = (F.col("_week") == F.col("_at")) & (F.col("_real") == 1)
    dense = weeks.select(
        keys.entity,
        year_of_index("_week", weeks_per_year).alias(keys.year),
        week_of_index("_week", weeks_per_year).alias(keys.week),
        *[F.when(own, F.col(m)).otherwise(F.lit(0)).alias(m) for m in measures], "_years")
    if observed_years_only:
        dense = dense.where(F.array_contains("_years", F.col(keys.year)))
    return dense.drop("_years")


def rows_without_week(panel: DataFrame, measures: Sequence[str] = ("cases",),
                      keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Per entity the rows that lack a year or week and the sums of their measures."""
    lost = panel.where(F.col(keys.year).isNull() | F.col(keys.week).isNull())
    return lost.groupBy(keys.entity).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(m).alias(m) for m in measures])


def alignment_report(panel: DataFrame, weather: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Per week: is it in the panel, in the weather table, or in both. Weeks are few."""
    left = panel.select(*keys.time).distinct().withColumn("_in_panel", F.lit(1))
    right = weather.select(*keys.time).distinct().withColumn("_in_weather", F.lit(1))
    both = F.col("_in_panel").isNotNull() & F.col("_in_weather").isNotNull()
    status = F.when(both, "both").when(F.col("_in_panel").isNotNull(), "panel only")
    return left.join(right, keys.time, "full").select(
        *keys.time, status.otherwise("weather only").alias("status"))


def weeks_missing_from(left: DataFrame, right: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Weeks of ``left`` that ``right`` lacks."""
    return left.select(*keys.time).distinct().join(
        right.select(*keys.time).distinct(), keys.time, "left_anti")


def shared_weeks(left: DataFrame, right: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    return left.select(*keys.time).intersect(right.select(*keys.time))


def join_weather(panel: DataFrame, weather: DataFrame, keys: Keys = DEFAULT_KEYS,
                 drop: Sequence[str] = ("start_date", "n_days")) -> DataFrame:
    """Widen the panel by a table with one row per week.

    That table is bounded by the calendar, so it is broadcast and the panel does not move.
    """
    return panel.join(F.broadcast(weather.drop(*drop)), keys.time, "left").select(
        *panel.columns, *[c for c in weather.columns if c not in (*keys.time, *drop)])


def join_population(panel: DataFrame, population: DataFrame, keys: Keys = DEFAULT_KEYS,
                    column: str = "population") -> DataFrame:
    """Add the population of each entity. Spark broadcasts the dimension if its size allows."""
    return panel.join(population.select(keys.entity, column), keys.entity, "left").select(
        *panel.columns, column)


def week_totals(panel: DataFrame, count: str = "cases", keys: Keys = DEFAULT_KEYS,
                constant: Sequence[str] = ()) -> DataFrame:
    """Total over entities per week; ``constant`` columns have one value per week."""
    return panel.groupBy(*keys.time).agg(
        F.sum(count).alias("total"), *[F.min(c).alias(c) for c in constant])


def rebuild(splits: Mapping[str, DataFrame], keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Put split tables back together, each row tagged with its split."""
    return combine_sources([
        table.drop("split").withColumn("split", F.lit(name)) for name, table in splits.items()
    ])
