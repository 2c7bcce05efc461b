"""Shards of a corpus along a Hilbert curve over its metadata.

Several metadata columns are quantised, the documents sorted by their cell's index on a Hilbert
curve, and the sorted run cut into shards. A shard then spans a narrow box in every dimension
at once, so that a reader that filters on any of them skips most files.

Everything is DataFrame functions. One range sort moves narrow rows only (no texts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.session import settled

BITS = 5


def cuts(docs: DataFrame, column: str, bits: int = BITS) -> list[str]:
    """At most ``2**bits - 1`` values that cut a column's distinct values into equal cells.

    Order-preserving quantisation: a value's cell is the number of cuts that it reaches.
    Nulls lie below all cuts.
    """
    values = docs.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct()
    cells = 1 << bits
    ranked = values.select(
        "v", F.row_number().over(Window.orderBy("v")).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    at = F.floor((F.col("i") - 1) * cells / F.col("n"))
    before = F.floor((F.col("i") - 2) * cells / F.col("n"))
    rows = ranked.where(F.col("i") > 1).where(at > before).select("v").collect()
    return sorted(r.v for r in rows)


def cell_of_text(column: str, bounds: list[str]) -> Column:
    value = F.col(column).cast("string")
    reached = [F.when(value >= F.lit(b), F.lit(1)).otherwise(F.lit(0)) for b in bounds]
    total = F.lit(0)
    for one in reached:
        total = total + one
    return total.cast("int")


def cell_of_size(size: Column, bits: int = BITS) -> Column:
    """Power of two just above a size, at most ``2**bits - 1``."""
    return F.least(F.length(F.bin(size)), F.lit((1 << bits) - 1)).cast("int")


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Position of a cell on the Hilbert curve of ``len(axes)`` dimensions, as a long.

    Each axis holds ``bits`` bits. Works from the high bit down: a set bit inverts the lower bits
    of the first axis, a clear bit exchanges them with it; a Gray code then gives the index.
    """
    n = len(axes)
    zero = F.lit(0)
    state = F.array(*[a.cast("int") for a in axes])

    def turn(cell: Column, step: Column) -> Column:
        bit = F.lit(bits - 1) - F.floor(step / n).cast("int")
        axis = (step % n).cast("int")
        low = F.call_function("shiftleft", F.lit(1), bit) - 1
        here, first = F.get(cell, axis), F.get(cell, zero)
        is_set = here.bitwiseAND(low + 1) != 0
        swap = first.bitwiseXOR(here).bitwiseAND(low)

        def moved(value: Column, i: Column) -> Column:
            flipped = F.when(i == 0, value.bitwiseXOR(low)).otherwise(value)
            swapped = F.when((i == 0) | (i == axis), value.bitwiseXOR(F.when(axis == 0, 0).otherwise(swap))).otherwise(value)
            return F.when(is_set, flipped).otherwise(swapped)

        return F.transform(cell, moved)

    turned = F.aggregate(F.sequence(zero, F.lit(bits * n - 1)), state, turn)
    gray = F.transform(
        F.sequence(zero, F.lit(n - 1)),
        lambda i: F.aggregate(F.slice(turned, F.lit(1), i + 1), zero, lambda acc, v: acc.bitwiseXOR(v)))

    def index(cell: Column) -> Column:
        last = F.get(cell, F.lit(n - 1))
        fix = F.aggregate(
            F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)) if bits > 1 else F.array(), zero,
            lambda acc, b: F.when(last.bitwiseAND(F.call_function("shiftleft", F.lit(1), b)) != 0,
                                  acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1), b) - 1)).otherwise(acc))
        return F.aggregate(
            F.sequence(zero, F.lit(bits * n - 1)), F.lit(0).cast("long"),
            lambda acc, step: acc * 2 + F.call_function(
                "shiftright", F.get(cell, (step % n).cast("int")).bitwiseXOR(fix),
                F.lit(bits - 1) - F.floor(step / n).cast("int")).bitwiseAND(F.lit(1)))

    # One-element transforms name a value once, so that it is computed once.
    return F.get(F.transform(F.array(gray), index), zero)


def hilbert_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text",
                   dimensions: tuple[str, ...] = ("lang", "source"), bits: int = BITS) -> DataFrame:
    """Put every document into a shard; counts of shards differ by one at most (law ``rows``).

    Rows: key, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot (gapless
    from 0 within the shard), grown_shard (null under this law), cell (index on the curve).

    Dimensions are the named columns and the size. Equal texts take the cell of the one with the
    smallest key and are neighbours on the curve, so that only a cut can part them. Null texts
    count as empty, null metadata as a value below all others; repeated rows each get a slot
    (equal keys in any order); an empty table gives no rows; other columns are ignored.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    axes = [cell_of_text(c, cuts(docs, c, bits)) for c in dimensions]
    axes = [F.coalesce(a, F.lit(0)) for a in axes]
    rows = docs.select(
        F.col(key).alias("_key"), F.octet_length(content).cast("long").alias("_bytes"),
        F.crc32(F.encode(content, "UTF-8")).alias("_crc"), F.md5(content).alias("_digest"),
        F.struct(*[a.alias(f"a{i}") for i, a in enumerate(axes)]).alias("_axes"))
    curve = hilbert_index(
        [F.col(f"_axes.a{i}") for i in range(len(axes))] + [cell_of_size(F.col("_bytes") + 1, bits)], bits)
    rows = settled(rows.select("_key", "_bytes", "_crc", "_digest", curve.alias("_cell")), "shard-rows")
    # Only texts that occur more than once need their group's cell. Written, so that both sides
    # of the join are plain exchanges and a hot text is split.
    shared = settled(
        rows.groupBy("_digest").agg(F.count("*").alias("_n"), F.min_by("_cell", "_key").alias("_shared"))
        .where("_n > 1").drop("_n"), "shard-groups")
    placed = rows.join(shared, "_digest", "left").select(
        "_key", "_bytes", "_crc", "_digest", F.coalesce("_shared", "_cell").alias("_cell"))
    # The id of a sorted row names its partition (high bits) and its place in it (low bits).
    ordered = settled(
        placed.orderBy("_cell", "_digest", "_key").withColumn("_id", F.monotonically_increasing_id()), "shard-order")
    part = F.shiftrightunsigned("_id", 33).alias("_part")
    counts = ordered.groupBy(part).agg(F.count("*").alias("_rows"))
    # One row for each partition of the sort.
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy()).alias("_total"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    at = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("_place", place)
    shard = F.expr(f"cast(_place * {shards} div _total as int)")
    first = F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    return at.withColumn("shard", shard).select(
        F.col("_key").alias(key), (F.col("_bytes") + 1).alias("size"), F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", (F.col("_place") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("_cell").alias("cell"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the documents as one folder per shard, each in slot order, for file pruning."""
    rows = docs.select(F.col(key).alias("key"), F.struct("*").alias("document"))
    joined = rows.join(placed.select(F.col(key).alias("key"), "shard", "slot"), "key").drop("key")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").parquet(path)
