"""Exact ranks and quantiles without sorting a whole group in one task.

Values are first collapsed to distinct values with counts, so a value that fills a third of
the table becomes one row. The distinct values are then cut into buckets at approximate
quantiles. A bucket is a function of the value, so ties never part, and the approximate cuts
steer only the balance of work: the running counts inside buckets plus the totals of the
buckets before are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COARSE = 16
_FINE = 16


def melt(rows: DataFrame, columns: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Long form (ids, variable, value) without nulls."""
    doubles = rows.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(list(ids), list(columns), "variable", "value").where("value is not null")


def distinct_positions(rows: DataFrame, value: str, by: Sequence[str] = (),
                       sums: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per group and distinct value: count ``n``, rows ``before`` it, group ``total``.

    ``sums`` adds further summed columns per distinct value. A null group is a group.
    """
    groups, extra = list(by), dict(sums or {})
    distinct = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in extra.items()])
    bucketed = _bucketed(distinct, value)
    # At most one row per group and bucket, so this window stays small.
    sizes = bucketed.groupBy(*groups, "_bucket").agg(F.sum("n").alias("_size"))
    ordered = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *groups, "_bucket",
        F.coalesce(F.sum("_size").over(ordered), F.lit(0)).alias("_offset"),
        F.sum("_size").over(Window.partitionBy(*groups)).alias("total"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1)
    placed = bucketed.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return join_groups(placed, offsets, groups, ["_bucket"]).select(
        *groups, value, "n", (F.col("_offset") + F.col("_inside")).alias("before"), "total", *extra)


def join_groups(left: DataFrame, right: DataFrame, groups: Sequence[str], keys: Sequence[str],
                how: str = "inner") -> DataFrame:
    """Join on groups, where null meets null, and on keys. Columns of ``left`` come once."""
    names = {c: f"_right_{c}" for c in (*groups, *keys)}
    other = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    on = [F.col(c).eqNullSafe(F.col(names[c])) for c in groups] + [F.col(c) == F.col(names[c]) for c in keys]
    return left.join(other, on, how).drop(*names.values())


def exact_quantiles(rows: DataFrame, value: str, probabilities: Mapping[str, float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles, one column per name."""
    positions = distinct_positions(rows, value, by)

    def at(rank: Column) -> Column:
        here = (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
        return F.max(F.when(here, F.col(value).cast("double")))

    picked, out = [], []
    for name, p in probabilities.items():
        place = (F.col("total") - 1) * F.lit(float(p))
        picked += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"),
                   F.max(place - F.floor(place)).alias(f"_w_{name}")]
        low, high, weight = (F.col(f"_{part}_{name}") for part in ("lo", "hi", "w"))
        out.append((low + (high - low) * weight).alias(name))
    return positions.groupBy(*by).agg(*picked).select(*by, *out)


def average_ranks(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their rank, tied values sharing the mean of their places."""
    rank = F.col("before") + (F.col("n") + 1) / F.lit(2.0)
    return distinct_positions(rows, value, by).select(*by, value, "n", "total", rank.alias("rank"))


def attach_rank(rows: DataFrame, ranks: DataFrame, value: str, by: Sequence[str],
                name: str, hot_share: int = 1000) -> DataFrame:
    """Give every row the rank of its value.

    A value that fills more than ``1 / hot_share`` of its group could swamp one task of a
    shuffled join. There are fewer than ``hot_share`` of those per group, so they are broadcast
    and the rest is joined by shuffle.
    """
    keys = [*by, value]
    hot = F.col("n") * hot_share > F.col("total")
    common = ranks.where(hot).select(*keys, F.col("rank").alias(name))
    rare = ranks.where(~hot).select(*keys, F.col("rank").alias(name))
    near = join_groups(rows, F.broadcast(common), by, [value])
    far = join_groups(rows, F.broadcast(common.select(*keys)), by, [value], "left_anti")
    return near.unionByName(join_groups(far, rare, by, [value]))


def _bucketed(distinct: DataFrame, value: str) -> DataFrame:
    """Add the index of the cut interval a value lies in, by a two-step search over the cuts."""
    steps = _COARSE * _FINE
    points = [i / steps for i in range(1, steps)]
    number = F.col(value).cast("double")
    # The count is always positive. Naming it keeps this branch equal to the main one, so that
    # both read one shuffle.
    counted = distinct.where(F.col("n") > 0)
    cuts = counted.agg(F.percentile_approx(number, points, 4 * steps)).scalar()
    coarse = _cuts_reached(number, lambda i: F.get("_cuts", F.lit((i + 1) * _FINE - 1)), 0, _COARSE - 1)
    start = F.col("_coarse") * _FINE
    fine = _cuts_reached(number, lambda i: F.get("_cuts", start + i), 0, _FINE - 1)
    return (
        distinct.withColumn("_cuts", cuts).withColumn("_coarse", coarse)
        .withColumn("_bucket", F.coalesce(start + fine, F.lit(0))).drop("_cuts", "_coarse")
    )


def _cuts_reached(number: Column, cut: Callable[[int], Column], low: int, high: int) -> Column:
    """How many of the ascending cuts are not above the number, by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(cut(middle) <= number, _cuts_reached(number, cut, middle + 1, high)).otherwise(
        _cuts_reached(number, cut, low, middle))
