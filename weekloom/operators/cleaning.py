"""Row-local cleaning, duplicate and gap reports, interpolation and outlier counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.keys import DEFAULT_KEYS, Keys
from weekloom.operators.ranks import exact_quantiles, melt
from weekloom.session import parts_for, settled

Bounds = Mapping[str, tuple[float | None, float | None]]

# Plausible ranges of daily weather and of the weekly master table; None is open.
# Counts and weekly rain have no upper end: what is much depends on the place and its size.
DAILY_WEATHER_BOUNDS: Bounds = {
    "temp_max": (-5, 45),
    "temp_min": (-5, 45),
    "temp_mean": (-5, 45),
    "precipitation": (0, 500),
    "humidity_max": (0, 100),
    "humidity_min": (0, 100),
}
MASTER_BOUNDS: Bounds = {
    "cases": (0, None),
    "temp_max_mean": (-5, 45),
    "temp_min_mean": (-5, 45),
    "temp_mean": (-5, 45),
    "precipitation": (0, None),
    "humidity_mean": (0, 100),
    "heat_index_mean": (-5, 60),
}
# First year and weeks a case row may carry. Years have no upper end.
YEAR_RANGE = (2018, None)
WEEK_RANGE = (1, 53)


def within(value: Column, low: float | None, high: float | None) -> Column:
    """Whether a value lies in an inclusive range; None is an open end. Null values give null."""
    held = value.isNotNull() if low is None and high is None else None
    if low is not None:
        held = value >= low
    if high is not None:
        held = value <= high if held is None else held & (value <= high)
    return F.when(value.isNotNull(), held)


def drop_unknown_labels(rows: DataFrame, label: str, unknown: Sequence[str]) -> DataFrame:
    """Drop rows whose trimmed, upper-case label is null or in ``unknown``."""
    return rows.where(~F.upper(F.trim(F.col(label))).isin(list(unknown)))


def map_labels(rows: DataFrame, mapping: DataFrame, label: str = "label",
               entity: str = "entity_id") -> DataFrame:
    """Replace a free-text label by its entity id; labels without an id are dropped.

    ``mapping`` has columns ``label`` and ``entity``. Spark broadcasts it if its size allows. A
    label listed twice with one id counts once; with different ids the job fails, since its rows
    would multiply.
    """
    ids = F.collect_set(entity)
    one = F.when(F.size(ids) > 1, F.raise_error(F.concat(F.lit("label with several ids: "), F.col("_code")))).otherwise(
        F.get(ids, F.lit(0)))
    codes = mapping.where(F.col(entity).isNotNull()).groupBy(F.col("label").alias("_code")).agg(one.alias(entity))
    normal = rows.withColumn("_code", F.upper(F.trim(F.col(label))))
    return normal.join(codes, "_code", "inner").drop("_code", label)


def unmapped_labels(rows: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    """Count of rows per label that has no entity id."""
    normal = rows.select(F.upper(F.trim(F.col(label))).alias("label"))
    counted = normal.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.join(mapping.select("label"), "label", "left_anti")


def clean_weeks(rows: DataFrame, keys: Keys = DEFAULT_KEYS,
                years: tuple[int | None, int | None] = YEAR_RANGE,
                weeks: tuple[int, int] = WEEK_RANGE) -> DataFrame:
    """Coerce year and week to integers and keep those in range; ``dropped_weeks`` counts the rest."""
    return (
        rows.withColumns({keys.year: whole_number(keys.year, "int"),
                          keys.week: whole_number(keys.week, "int")})
        .where(within(F.col(keys.year), *years) & within(F.col(keys.week), *weeks))
    )


def dropped_weeks(rows: DataFrame, keys: Keys = DEFAULT_KEYS,
                  years: tuple[int | None, int | None] = YEAR_RANGE,
                  weeks: tuple[int, int] = WEEK_RANGE) -> DataFrame:
    """How many rows ``clean_weeks`` drops, by reason (unreadable, year, week), in one pass."""
    year, week = whole_number(keys.year, "int"), whole_number(keys.week, "int")
    reason = (F.when(year.isNull() | week.isNull(), "unreadable")
              .when(~within(year, *years), "year").when(~within(week, *weeks), "week"))
    return rows.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(
        F.count(F.lit(1)).alias("n_rows"))


def clean_counts(rows: DataFrame, count: str = "cases") -> DataFrame:
    """Coerce counts, drop negatives, read null as zero.

    The rule looks at one row only: a null count stays (as 0) whether or not some other
    row is negative.
    """
    coerced = rows.withColumn(count, whole_number(count, "long"))
    return (
        coerced.where(F.col(count).isNull() | (F.col(count) >= 0))
        .withColumn(count, F.coalesce(F.col(count), F.lit(0).cast("long")))
    )


def whole_number(column: str, type_name: str) -> Column:
    """Whole number such as ``7`` or ``7.0``; null if it is none or has a fraction.

    Whole numbers of any size are read exactly; only other spellings go through a double.
    """
    text = F.trim(F.col(column).cast("string"))
    number = text.try_cast("double")
    exact = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast(type_name))
    return F.coalesce(exact, F.when(number == F.floor(number), number.try_cast(type_name)))


def limit_ranges(rows: DataFrame, bounds: Bounds) -> DataFrame:
    """Null out values outside their inclusive bounds, column by column."""
    present = {c: b for c, b in bounds.items() if c in rows.columns}
    return rows.withColumns({
        c: F.when(within(F.col(c), low, high), F.col(c)) for c, (low, high) in present.items()
    })


def out_of_range_counts(rows: DataFrame, bounds: Bounds) -> DataFrame:
    """Values outside their bounds per column, counted in one pass."""
    present = {c: b for c, b in bounds.items() if c in rows.columns}
    wide = rows.agg(*[
        F.count_if(~within(F.col(c), low, high)).alias(c) for c, (low, high) in present.items()
    ])
    return _to_long(wide, list(present), "n_out_of_range")


def missing_report(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percentage per column, in one pass."""
    names = list(columns or rows.columns)
    wide = rows.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in names],
    )
    long = _to_long(wide, names, "n_null", "_rows")
    pct = F.round(F.try_divide(F.col("n_null") * 100.0, F.col("_rows")), 2)
    return long.select("column", "n_null", pct.alias("pct_null"))


def duplicate_report(rows: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    counted = rows.groupBy(*keys.panel).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where(F.col("n_rows") > 1)


def first_per_key(rows: DataFrame, order: Sequence[str], keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Keep the first row of every key under a stated order.

    An aggregate, not a window: partial states combine before the shuffle, so a key that
    holds much of the table costs no more than any other.
    """
    rest = [c for c in rows.columns if c not in keys.panel]
    first = F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order]))
    return rows.groupBy(*keys.panel).agg(first.alias("_row")).select(
        *[F.col(c) if c in keys.panel else F.col(f"_row.{c}").alias(c) for c in rows.columns]
    )


def interpolate(rows: DataFrame, columns: Sequence[str], keys: Keys = DEFAULT_KEYS,
                by: Sequence[str] | None = None) -> DataFrame:
    """Fill nulls linearly by row position; edges take the nearest known value.

    Filling stays within ``by`` (default: the entity), so neighbouring entities never
    blend. One sort serves all columns, and a group's rows meet in one task. With ``by=[]`` the
    whole table is one series, ordered by week and entity, and no task holds more than its range.
    """
    groups = list(by) if by is not None else [keys.entity]
    if not groups:
        return _interpolate_whole(rows, columns, keys)
    order = Window.partitionBy(*groups).orderBy(keys.year, keys.week)
    placed = rows.withColumn("_pos", F.row_number().over(order))
    window = _window_sql(groups, [keys.year, keys.week])
    known = {c: f"if(`{c}` is not null, struct(_pos as pos, `{c}` as value), null)" for c in columns}
    around = placed.withColumns({
        **{f"_before_{c}": F.expr(f"lag({e}, 1) ignore nulls over ({window})")
           for c, e in known.items()},
        **{f"_after_{c}": F.expr(f"lead({e}, 1) ignore nulls over ({window})")
           for c, e in known.items()},
    })
    filled = {c: F.coalesce(F.col(c), _between(c)) for c in columns}
    return around.select(*[filled.get(c, F.col(c)).alias(c) for c in rows.columns])


def _interpolate_whole(rows: DataFrame, columns: Sequence[str], keys: Keys) -> DataFrame:
    """Interpolation over the order of the whole table, as a scan with carry.

    Rows are sorted into ranges. One row per range says how many rows it has and which values are
    known first and last; windows over those few rows give each range its first position and the
    known values next to it. Then every range is filled on its own. Rows without a week come
    first, and equal keys stand in any one order.
    """
    order = [*keys.time, keys.entity]
    many = [parts_for(rows) or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))]
    spread = rows.repartitionByRange(*many, *order).sortWithinPartitions(*order)
    # Written once: ranges and places must not change between the passes.
    placed = settled(spread.withColumn("_part", F.spark_partition_id()).withColumn(
        "_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_place").alias("pos"), F.col(c).alias("value"))) for c in columns}
    ranges = placed.groupBy("_part").agg(
        (F.max("_place") + 1).alias("_rows"),
        *[F.min_by(known[c], F.when(F.col(c).isNotNull(), F.col("_place"))).alias(f"_first_{c}") for c in columns],
        *[F.max_by(known[c], F.when(F.col(c).isNotNull(), F.col("_place"))).alias(f"_last_{c}") for c in columns])
    by_part = Window.orderBy("_part")  # one row per range
    before, after = by_part.rowsBetween(Window.unboundedPreceding, -1), by_part.rowsBetween(1, Window.unboundedFollowing)
    based = ranges.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0)))

    def moved(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.struct(
            (F.col("_base") + F.col(f"{name}.pos")).alias("pos"), F.col(f"{name}.value").alias("value")))

    carry = based.select("_part", "_base", *[
        F.last(moved(f"_last_{c}"), ignorenulls=True).over(before).alias(f"_carry_before_{c}") for c in columns], *[
        F.first(moved(f"_first_{c}"), ignorenulls=True).over(after).alias(f"_carry_after_{c}") for c in columns])
    # By range of the part, since several parts may hash to one task.
    joined = placed.join(carry, "_part").withColumn("_pos", F.col("_base") + F.col("_place")).repartitionByRange(*many, "_part")
    # Two sorted windows: a frame that is open to the following rows would be read anew for each row.
    earlier = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("_part").orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, -1)
    value = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("pos"), F.col(c).alias("value"))) for c in columns}
    around = joined.withColumns({
        **{f"_before_{c}": F.coalesce(F.last(v, ignorenulls=True).over(earlier), F.col(f"_carry_before_{c}")) for c, v in value.items()},
        **{f"_after_{c}": F.coalesce(F.last(v, ignorenulls=True).over(later), F.col(f"_carry_after_{c}")) for c, v in value.items()}})
    filled = {c: F.coalesce(F.col(c), _between(c)) for c in columns}
    return around.select(*[filled.get(c, F.col(c)).alias(c) for c in rows.columns])


def _between(column: str) -> Column:
    before, after = F.col(f"_before_{column}"), F.col(f"_after_{column}")
    step = (after["value"] - before["value"]) / (after["pos"] - before["pos"])
    inside = before["value"] + step * (F.col("_pos") - before["pos"])
    return (
        F.when(before.isNotNull() & after.isNotNull(), inside)
        .otherwise(F.coalesce(before["value"], after["value"]))
    )


def repair_ranges(rows: DataFrame, bounds: Bounds = MASTER_BOUNDS,
                  keys: Keys = DEFAULT_KEYS, by: Sequence[str] | None = None) -> DataFrame:
    """Null out-of-range values, then interpolate them. Integer columns become double."""
    columns = [c for c in bounds if c in rows.columns]
    as_double = rows.withColumns({c: F.col(c).cast("double") for c in columns})
    return interpolate(limit_ranges(as_double, bounds), columns, keys, by)


def standard_formats(rows: DataFrame, order: Sequence[str], decimals: int = 3,
                     keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Integer keys, floats rounded half to even, columns in a fixed order."""
    floats = {name for name, kind in rows.dtypes if kind in ("double", "float")}
    rest = [c for c in rows.columns if c not in order]

    def formatted(name: str) -> Column:
        if name in keys.panel:
            return F.col(name).cast("int").alias(name)
        if name in floats:
            return F.bround(F.col(name), decimals).alias(name)
        return F.col(name)

    return rows.select(*[formatted(c) for c in [*order, *rest]])


def date_gaps(days: DataFrame, date: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """Number of steps of more than one day, per series.

    A step longer than a day starts at a date whose next day is absent. The dates of a series are
    the bits of words of 64 days, which are merged before they move; ends inside a word are
    counted there, and a word's last day is paired with the first day of the next word. So no
    series is sorted in one task, and what moves are words, not dates.
    """
    groups = list(by)
    number = F.unix_date(F.col(date).cast("date"))
    one = F.lit(1).cast("long")
    words = days.where(F.col(date).isNotNull()).select(
        *groups, F.shiftright(number, 6).alias("_word"),
        F.call_function("shiftleft", one, number.bitwiseAND(F.lit(63))).alias("_bit"),
    ).groupBy(*groups, "_word").agg(F.bit_or("_bit").alias("_days"))
    later = F.shiftrightunsigned("_days", 1)
    marks = words.select(*groups, F.explode(F.array(
        F.struct("_word", F.bit_count(F.col("_days").bitwiseAND(F.bitwise_not(later))).alias("_ends"),
                 (F.col("_days") < 0).alias("_last"), F.lit(False).alias("_next")),
        F.struct((F.col("_word") - 1).alias("_word"), F.lit(0).alias("_ends"),
                 F.lit(False).alias("_last"), (F.col("_days").bitwiseAND(one) == 1).alias("_next")),
    )).alias("_mark")).select(*groups, "_mark.*").where("_ends > 0 OR _next")
    paired = marks.groupBy(*groups, "_word").agg(
        F.sum("_ends").alias("_ends"), (F.bool_or("_last") & F.bool_or("_next")).cast("long").alias("_joined"))
    return paired.groupBy(*groups).agg(
        (F.coalesce(F.sum(F.col("_ends") - F.col("_joined")), F.lit(0)) - 1).alias("n_gaps"))


def iqr_outliers(rows: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Values outside the quartiles by more than ``factor`` inter-quartile ranges.

    Quartiles are exact, from a distributed count of distinct values.
    """
    long = melt(rows, columns)
    quartiles = exact_quantiles(long, "value", {"q1": 0.25, "q3": 0.75}, by=["variable"])
    wide = quartiles.agg(F.map_from_entries(F.collect_list(
        F.struct("variable", F.struct("q1", "q3").alias("q")))).alias("q"))
    limits = F.col("_q")[F.col("variable")]
    reach = (limits["q3"] - limits["q1"]) * factor
    outside = (F.col("value") < limits["q1"] - reach) | (F.col("value") > limits["q3"] + reach)
    flagged = long.withColumn("_q", wide.scalar())
    counts = flagged.groupBy("variable").agg(
        F.count_if(outside).alias("n_outliers"), F.count(F.lit(1)).alias("n"))
    pct = F.try_divide(F.col("n_outliers") * 100.0, F.col("n"))
    return counts.select("variable", "n_outliers", "n", pct.alias("pct"))


def _to_long(wide: DataFrame, columns: Sequence[str], value: str, *kept: str) -> DataFrame:
    return wide.unpivot(list(kept), list(columns), "column", value)


def _window_sql(groups: Sequence[str], order: Sequence[str]) -> str:
    partition = f"partition by {', '.join(f'`{g}`' for g in groups)} " if groups else ""
    return f"{partition}order by {', '.join(f'`{o}`' for o in order)}"
