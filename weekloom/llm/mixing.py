"""Mixing sources to target weights by budgets that run down a tree.

A token budget starts at the root of a tree (domain, language, source) and is split among the
children of every node by their weights. A child that cannot use its part, because its documents
times the allowed epochs hold fewer tokens, leaves the rest to its siblings; only what a whole
branch cannot use goes to the branches beside its parent. A leaf then takes whole passes over its
documents (epochs) and of one more epoch, in an order of its own, the first documents until the
budget is reached.

DataFrame functions only. Texts are read once, to count tokens; what moves are narrow rows, and
rows that agree in key, text and leaf move as one with a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.session import settled

LEVELS = ("domain", "lang", "source")
TOKEN = r"[^\x20\x09-\x0D]+"
#: Hex digits of the order's digest that name a bucket of a leaf; buckets are ordered one by one.
BUCKET_DIGITS = 3
#: Copies of one row that a task makes at most.
COPIES = 4096


def split_budget(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Give every child its part of ``budget`` (the parent's), at most its ``capacity``.

    Children that are filled are those with the least capacity for their weight; the others share
    what remains by weight, in whole tokens, and the tokens that rounding leaves go one each to
    the first by capacity for weight, then by name.
    """
    by = Window.partitionBy(*parent)
    ratio = F.col("capacity") / F.col("weight")
    order = by.orderBy(ratio, name)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    seen = nodes.withColumn("_before", before).withColumn("_rest", rest).withColumn("_ratio", ratio)
    seen = seen.withColumn("_full", F.expr(
        "cast(capacity as decimal(38,0)) * _rest <= cast(weight as decimal(38,0)) * (budget - _before)"))
    filled = F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(by), F.lit(0))
    weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(by)
    seen = seen.withColumn("_left", F.col("budget") - filled).withColumn("_weight", weight)
    part = F.when(F.col("_full"), F.col("capacity")).otherwise(
        F.expr("cast((cast(weight as decimal(38,0)) * _left) div _weight as bigint)"))
    seen = seen.withColumn("_part", part)
    odd = F.col("_left") - F.sum(F.when(~F.col("_full"), F.col("_part"))).over(by)
    place = F.row_number().over(Window.partitionBy(*parent, "_full").orderBy("_ratio", name))
    seen = seen.withColumn("_odd", odd).withColumn("_place", place)
    more = F.when(~F.col("_full") & (F.col("_place") <= F.col("_odd")), F.lit(1)).otherwise(F.lit(0))
    return seen.withColumn("part", (F.col("_part") + more).cast("long")).drop(
        "_before", "_rest", "_ratio", "_full", "_left", "_weight", "_part", "_odd", "_place")


def leaf_budgets(leaves: DataFrame, weights: dict[str, Column], share: float, max_epochs: int,
                 levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Budgets of all leaves (levels, supply). ``weights`` gives each level's weight, a positive
    whole number computed from the level's columns and those above it; levels not named weigh 1."""
    sized = leaves.withColumn("capacity", F.col("supply") * max_epochs)
    total = leaves.agg(F.floor(F.sum("supply") * F.lit(share)).cast("long").alias("t"), F.sum("supply").alias("s")).first()
    above = None
    for depth, name in enumerate(levels):
        path = list(levels[:depth + 1])
        nodes = sized.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn(
            "weight", weights.get(name, F.lit(1)).cast("long"))
        if above is None:
            nodes = nodes.withColumn("budget", F.least(F.lit(total.t or 0), F.lit((total.s or 0) * max_epochs)).cast("long"))
        else:
            nodes = nodes.join(above, path[:-1])
        above = split_budget(nodes, path[:-1], name).select(*path, F.col("part").alias("budget"))
    return above.join(leaves, list(levels))


def mixture(docs: DataFrame, weights: dict[str, Column], share: float = 1.0, max_epochs: int = 2, seed: str = "mix",
            domain: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The mixture as rows (key, domain, lang, source, epoch, n_tokens, leaf_tokens, tag, copies).

    One row for each epoch (from 0) that a document is taken in; leaf_tokens is the leaf's budget,
    tag a digest of the text. Rows that agree in key, text and leaf are one row, with the number
    of them that the epoch takes as copies.
    The budget in all is ``share`` of the corpus's tokens, or all that ``max_epochs`` passes give.
    A leaf's last epoch takes documents, in the order of seeded digests of their keys, as long as
    the tokens before them are fewer than the budget, so it exceeds it by less than a document.

    Null metadata counts as the empty name, null and empty texts have no tokens; a document
    without key is placed by its text, and rows that share a key each count; an empty table gives
    no rows; other columns are ignored.
    """
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    path = list(LEVELS)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(key).cast("string"), F.md5(whole.cast("binary"))).alias("name"),
        F.xxhash64(text).alias("tag"), named(F.lit("") if domain is None else domain).alias("domain"),
        named(F.col("lang")).alias("lang"), named(F.col("source")).alias("source"),
        F.regexp_count(whole, F.lit(TOKEN)).cast("long").alias("n_tokens"))
    rows = settled(rows.groupBy("key", "name", "tag", *path, "n_tokens").agg(F.count("*").alias("rows")), "mix-rows")
    leaves = settled(rows.groupBy(*path).agg(F.sum(F.col("n_tokens") * F.col("rows")).alias("supply")), "mix-leaves")
    # Both sides of the join are tables, so a source that holds much of the corpus is split.
    budgets = settled(leaf_budgets(leaves, weights, share, max_epochs).select(
        *path, "budget", F.expr("CASE WHEN supply > 0 THEN budget div supply ELSE 0 END").alias("passes"),
        F.expr("CASE WHEN supply > 0 THEN budget % supply ELSE 0 END").alias("rest")), "mix-budgets")
    joined = rows.join(budgets, path)
    digest = F.md5(F.concat_ws("-", F.lit(seed), F.col("passes").cast("string"), "name"))
    joined = settled(joined.withColumn("digest", digest).withColumn("bucket", F.substring("digest", 1, BUCKET_DIGITS)), "mix-ordered")
    # Tokens before a document: those of earlier buckets of its leaf and of earlier rows of its bucket.
    sums = joined.groupBy(*path, "bucket").agg(F.sum(F.col("n_tokens") * F.col("rows")).alias("s"))
    ahead = Window.partitionBy(*path).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*path, "bucket", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("start"))
    within = Window.partitionBy(*path, "bucket").orderBy("digest", "key", "n_tokens", "tag").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("inner", F.coalesce(F.sum(F.col("n_tokens") * F.col("rows")).over(within), F.lit(0))).join(starts, [*path, "bucket"])
    # Of equal rows the last epoch takes the first ones, as long as tokens are left.
    taken = placed.withColumn("room", F.col("rest") - F.col("start") - F.col("inner")).withColumn("more", F.expr(
        "CASE WHEN room <= 0 THEN 0 WHEN n_tokens = 0 THEN rows ELSE least(rows, (room + n_tokens - 1) div n_tokens) END"))
    taken = taken.withColumn("epochs", F.col("passes") + F.when(F.col("more") > 0, 1).otherwise(0)).where("epochs > 0")
    taken = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("epochs") - 1).cast("int"))))
    return taken.select(
        F.col("key").alias(key), *path, "epoch", "n_tokens", F.col("budget").alias("leaf_tokens"), "tag",
        F.when(F.col("epoch") < F.col("passes"), F.col("rows")).otherwise(F.col("more")).cast("long").alias("copies"))


def repeated(rows: DataFrame, times: str) -> DataFrame:
    """Every row as often as column ``times``, which goes, says; very many copies are made by several tasks."""
    few = rows.where(F.col(times) <= COPIES).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    lots = rows.where(F.col(times) > COPIES).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.expr(f"cast(({times} - 1) div {COPIES} as int)")))).repartition("_i")
    lots = lots.withColumn("_j", F.explode(F.sequence(F.lit(1), F.expr(f"cast(least({COPIES}, {times} - _i * {COPIES}) as int)")))).drop("_j")
    return few.unionByName(lots).drop("_i", times)


def mixed_documents(docs: DataFrame, chosen: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns, once for each epoch they are taken in.

    Documents without key are found by their text. Of rows that share key, text, language and
    source each comes as often as all of them can, and what is over as copies of any of them.
    """
    name = ["_key", "_tag", "_lang", "_source"]
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    times = chosen.select(F.col(key).alias("_key"), F.col("tag").alias("_tag"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), "copies")
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_tag"), empty("lang").alias("_lang"), empty("source").alias("_source"), F.struct("*").alias("_row"))
    # One aggregation holds both the documents of a name and how often they are taken.
    counts = times.withColumn("_n", F.lit(0)).unionByName(rows.select(*name, F.lit(0).cast("long").alias("copies"), F.lit(1).alias("_n")))
    counts = settled(counts.groupBy(*name).agg(F.sum("copies").alias("_t"), F.sum("_n").alias("_n")).where("_t > 0").select(
        *[F.col(c).alias(f"w{c}") for c in name], F.expr("_t div _n").alias("_times"), F.expr("_t % _n").alias("_over")), "mix-times")
    same = F.lit(True)
    for c in name:
        same = same & F.col(c).eqNullSafe(F.col(f"w{c}"))
    every = rows.join(counts.where("_times > 0"), same).select("_row", "_times")
    over = rows.join(counts.where("_over > 0"), same).groupBy(*name).agg(F.first("_row").alias("_row"), F.first("_over").alias("_over"))
    return repeated(every, "_times").select("_row.*").unionByName(repeated(over.select("_row", "_over"), "_over").select("_row.*"))
