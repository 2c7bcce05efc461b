"""Delimited text as it is exported: each file with its own separator, column order and encoding.

Every file under a path has a header line of its own, which gives its separator and its columns.
The encoding is decided line by line. A quoted field may hold line feeds; its lines are put
together before the record is parsed.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekloom.session import settled

_BOM = "﻿"
SEPARATORS = ",;\t|"


def read_delimited(spark: SparkSession, path: str | Sequence[str], required: Sequence[str] = (), separators: str = SEPARATORS,
                   columns: Sequence[str] | None = None, file_column: str | None = None) -> DataFrame:
    """Read headed text into all-string columns, whatever order each file has them in.

    The result has ``columns``, or all names of all headers in the order of the first file that
    has them; a file without one of them gives nulls there, but each must have those in
    ``required``. ``file_column`` adds the path of a row's file. Blank lines and repeated header
    lines are not records. A quote that no later line of its file closes is a plain character.
    """
    lines = text_lines(spark, path)
    files = dialects(lines, separators)
    report = files.agg(
        F.max(F.size("names")).alias("width"), F.max("multi").alias("multi"),
        F.min(F.when(~F.forall(F.array(*map(F.lit, required)), lambda c: F.array_contains("names", c)), F.col("file"))).alias("lacking")
        if required else F.lit(None).alias("lacking")).first()
    if report.width is None:
        raise ValueError(f"no header line in {path}")
    if report.lacking is not None:
        names = files.where(F.col("file") == report.lacking).first().names
        raise ValueError(f"{report.lacking} lacks columns {[c for c in required if c not in names]}")
    if columns is None:
        first = files.select("file", F.posexplode("names").alias("place", "name")).groupBy("name").agg(
            F.min(F.struct("file", "place")).alias("first"))
        columns = [r.name for r in first.orderBy("first").collect()]  # as many as the result has columns
    rows = records(lines, files, separators, report.multi)
    schema = ", ".join(f"c{i} string" for i in range(report.width))
    parsed = F.coalesce(*[
        F.when(F.col("separator") == s, F.from_csv("record", schema, {"sep": s, "mode": "PERMISSIVE", "escape": '"'})) for s in separators])
    fields = F.array(*[F.col(f"row.c{i}") for i in range(report.width)])
    place = lambda c: F.array_position("names", F.lit(c)).cast("int")
    kept = [F.col("file").alias(file_column)] if file_column else []
    return rows.withColumn("row", parsed).withColumn("fields", fields).select(
        *kept, *[F.when(place(c) > 0, F.get("fields", place(c) - 1)).alias(c) for c in columns])


def text_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines with their place: file, start of the split in it, and a number that rises within the split."""
    return spark.read.text(path if isinstance(path, str) else list(path)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("n"), _decoded().alias("line"))


def _decoded() -> Column:
    raw = F.col("value")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(raw.cast("binary"), "ISO-8859-1"))


def dialects(lines: DataFrame, separators: str = SEPARATORS) -> DataFrame:
    """One row per file: header, separator, names of its columns, and whether a record may span lines.

    The separator is the one the header holds most often, the first of equals.
    """
    opening = [F.max(_opens(s)).alias(f"multi{i}") for i, s in enumerate(separators)]
    heads = lines.groupBy("file").agg(F.min_by("line", F.struct("split", "n")).alias("header"), *opening)
    clean = F.regexp_replace("header", f"^{_BOM}", "")
    often = F.array(*[F.struct((F.length(clean) - F.length(F.replace(clean, F.lit(s), F.lit("")))).alias("times"),
                               F.lit(-i).alias("rank"), F.lit(s).alias("separator"), F.col(f"multi{i}").alias("multi"))
                      for i, s in enumerate(separators)])
    chosen = heads.withColumn("best", F.array_max(often)).select("file", "header", "best.separator", "best.multi", clean.alias("clean"))
    names = F.coalesce(*[F.when(F.col("separator") == s, F.split("clean", re.escape(s))) for s in separators])
    return settled(chosen.select(
        "file", "header", "separator", "multi",
        F.transform(names, lambda x: F.trim(F.regexp_replace(F.trim(x), '^"|"$', ""))).alias("names")), "dialects")


def _opens(separator: str) -> Column:
    """Whether a line that starts outside quotes ends inside a quoted field."""
    return F.col("line").contains('"') & F.col("line").rlike(rf'^{_fields(separator)}"{_INSIDE}$')


def _stays(separator: str) -> Column:
    """Whether a line that starts inside a quoted field ends inside one."""
    s = re.escape(separator)
    reopened = rf'^{_INSIDE}"[^{s}]*+{s}{_fields(separator)}"{_INSIDE}$'
    return ~F.col("line").contains('"') | F.col("line").rlike(rf"^{_INSIDE}$") | F.col("line").rlike(reopened)


# Text of a quoted field, where two quotes stand for one; possessive, so that no line is tried twice.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'


def _fields(separator: str) -> str:
    s = re.escape(separator)
    return rf'(?:(?:"{_INSIDE}"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+'


def records(lines: DataFrame, files: DataFrame, separators: str = SEPARATORS, multi: bool = True) -> DataFrame:
    """One row per record: file, separator, names and ``record``.

    Files whose lines never end inside quotes are read where they lie; only the others are put in
    the order of their lines.
    """
    placed = lines.join(files, "file")
    body = (F.col("line") != F.col("header")) & (F.trim("line") != "")
    columns = ["file", "separator", "names"]
    plain = placed.where(~F.col("multi") & body).select(*columns, F.col("line").alias("record"))
    return plain.unionByName(_joined(placed.where("multi"), columns, separators)) if multi else plain


def _joined(lines: DataFrame, columns: list[str], separators: str) -> DataFrame:
    """Records of files whose quoted fields hold line feeds.

    A line maps the state before it (inside quotes or not) to the state after it, and such maps
    compose. So states run through each split on its own, then through one row per split, which
    carries the state, and the record it is in, over to the next split. No task needs a whole file.
    """
    line = Window.partitionBy("file", "split").orderBy("n")
    opens = F.coalesce(*[F.when(F.col("separator") == s, _opens(s)) for s in separators])
    stays = F.coalesce(*[F.when(F.col("separator") == s, _stays(s)) for s in separators])
    known = lines.withColumn("opens", opens).withColumn("stays", stays).withColumns({
        "fixed": F.when(F.col("opens") == F.col("stays"), F.col("opens")), "flip": (F.col("opens") & ~F.col("stays")).cast("int")})
    run = _run(known, line)
    fixed = F.col("fixed_") != (F.col("since") == 1)
    splits = run.groupBy("file", "split").agg(
        F.max_by(fixed, "n").alias("fixed"), F.max_by(F.when(fixed.isNull(), F.col("since")).otherwise(0), "n").alias("flip"))
    whole = Window.partitionBy("file").orderBy("split")
    ends = _run(splits, whole).withColumn("after", _state(F.lit(False)))
    starts = ends.select("file", "split", F.coalesce(F.lag("after").over(whole), F.lit(False)).alias("first"))
    states = run.join(starts, ["file", "split"]).withColumn("after", _state(F.col("first"))).withColumn(
        "before", F.coalesce(F.lag("after").over(line), F.col("first")))
    # The line a record starts with, also where that lies in an earlier split.
    owned = states.withColumn("own", F.last(F.when(~F.col("before"), F.struct("split", "n")), ignorenulls=True).over(line))
    carried = owned.groupBy("file", "split").agg(F.max("own").alias("own"), F.max_by("after", "n").alias("after"))
    earlier = whole.rowsBetween(Window.unboundedPreceding, -1)
    everything = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = carried.select(
        "file", "split", F.last("own", ignorenulls=True).over(earlier).alias("carry"),
        F.when(F.last("after").over(everything), F.last("own", ignorenulls=True).over(everything)).alias("unclosed"))
    named = owned.join(carried, ["file", "split"]).withColumn("start", F.coalesce("own", "carry"))
    alone = ~(F.col("before") | F.col("after")) | F.col("start").eqNullSafe(F.col("unclosed"))
    single = named.where(alone & (F.col("line") != F.col("header")) & (F.trim("line") != "")).select(*columns, F.col("line").alias("record"))
    several = named.where(~alone).groupBy("file", "start").agg(
        *[F.first(c).alias(c) for c in columns[1:]], F.array_sort(F.collect_list(F.struct("split", "n", "line"))).alias("parts"))
    return single.unionByName(several.select(*columns, F.array_join(F.col("parts.line"), "\n").alias("record")))


def _run(rows: DataFrame, order: Window) -> DataFrame:
    """``fixed_``: the last fixed state up to each row; ``since``: whether it was flipped an odd number of times since."""
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    flips = rows.withColumn("flips", F.sum("flip").over(upto))
    at = F.coalesce(F.last(F.when(F.col("fixed").isNotNull(), F.col("flips")), ignorenulls=True).over(upto), F.lit(0))
    return flips.withColumn("fixed_", F.last("fixed", ignorenulls=True).over(upto)).withColumn(
        "since", ((F.col("flips") - at) % 2).cast("int"))


def _state(first: Column) -> Column:
    return F.coalesce(F.col("fixed_"), first) != (F.col("since") == 1)
