"""Codes for vectors: each part of a vector becomes the number of its nearest codebook entry.

Codebooks are trained by Lloyd rounds over two trees, one over a block's parts and one over the
entries. Bounds on the distance between two nodes drop entries for a whole node of parts; a node
that one entry is left for hands on its cached sums; leaves that stay uncertain compare integers.
All arithmetic is on integers, so results do not depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.session import settled

LEAF = 64
BLOCK = 2048
EXACT = 1 << 53


class Boxes(NamedTuple):
    """A tree over rows: node i holds rows first[i] to last[i]; children are 2i+1 and 2i+2, where they exist."""

    order: np.ndarray  # rows of the block in the order of the leaves
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray


def boxes(points: np.ndarray, leaf: int) -> Boxes:
    """Halves along the widest side, down to ``leaf`` rows. All nodes of a level split alike."""
    n, width = points.shape
    levels = 0
    while -(-n // (1 << levels)) > leaf:
        levels += 1
    size = (2 << levels) - 1
    order = np.arange(n)
    first, last = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    low, high = np.zeros((size, width), dtype=np.int64), np.zeros((size, width), dtype=np.int64)
    last[0] = n
    for node in range(size):
        a, b = first[node], last[node]
        inside = points[order[a:b]]
        low[node], high[node] = inside.min(axis=0, initial=np.iinfo(np.int64).max), inside.max(axis=0, initial=np.iinfo(np.int64).min)
        if 2 * node + 2 < size:
            middle = (a + b) // 2
            if width and b - a > 1:
                side = int(np.argmax(high[node] - low[node]))
                order[a:b] = order[a:b][np.argpartition(inside[:, side], middle - a, kind="introselect")]
            first[2 * node + 1], last[2 * node + 1] = a, middle
            first[2 * node + 2], last[2 * node + 2] = middle, b
    return Boxes(order, first, last, low, high)


def squared_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, in doubles where these hold them, else in integers."""
    reach = int(max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * reach * reach * max(points.shape[1], 1) < EXACT:
        x, e = points.astype(float), entries.astype(float)
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ e.T) + (e * e).sum(axis=1)[None, :]
    out = np.zeros((len(points), len(entries)), dtype=np.int64 if 4 * reach * reach * points.shape[1] < 1 << 63 else object)
    for d in range(points.shape[1]):
        gap = points[:, d].astype(out.dtype)[:, None] - entries[:, d].astype(out.dtype)[None, :]
        out += gap * gap
    return out


class Part(NamedTuple):
    """One part of a block's vectors: its rows in leaf order, their tree and the sums of its nodes."""

    points: np.ndarray
    tree: Boxes
    sums: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray) -> "Part":
        tree = boxes(points, LEAF)
        ordered = points[tree.order]
        running = np.concatenate([np.zeros((1, points.shape[1]), dtype=np.int64), np.cumsum(ordered, axis=0)])
        return cls(ordered, tree, running[tree.last] - running[tree.first])


class Assigner:
    """Finds the nearest entries of one codebook (ties: the lower number) for trees of parts."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.tree = boxes(entries, 1)
        self.wide = (len(self.tree.first) - 1) // 2  # nodes from here on are leaves
        # Box sums stay far below the limits of doubles for any weight whose distances do.
        self.low, self.high = self.tree.low.astype(float), self.tree.high.astype(float)

    def members(self, nodes: np.ndarray) -> np.ndarray:
        """Entries below the nodes, in rising order."""
        tree = self.tree
        return np.sort(np.concatenate([tree.order[tree.first[i]:tree.last[i]] for i in nodes]))

    def bounded(self, low: np.ndarray, high: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The nodes that may hold a nearest entry for some place of the box."""
        gap = np.maximum(np.maximum(self.low[nodes] - high, low - self.high[nodes]), 0)
        reach = np.maximum(np.abs(self.high[nodes] - low), np.abs(high - self.low[nodes]))
        nearest, farthest = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
        return nodes[nearest <= farthest.min() * (1 + 1e-12)]

    def walk(self, part: Part) -> Iterator[tuple[int, int | None, int, np.ndarray | None]]:
        """Yields (node, entry, first row, numbers): a whole node's entry, or the entries of a leaf's rows."""
        tree, leaves = part.tree, (len(part.tree.first) - 1) // 2
        todo = [(0, np.zeros(1, dtype=np.int64))]
        filled = self.tree.last > self.tree.first
        while todo:
            node, candidates = todo.pop()
            a, b = tree.first[node], tree.last[node]
            if a == b:
                continue
            low, high = tree.low[node].astype(float), tree.high[node].astype(float)
            candidates = self.bounded(low, high, candidates)
            if node >= leaves:
                while (candidates < self.wide).any() and len(candidates) < len(self.entries):
                    candidates = self.bounded(low, high, self.below(candidates, filled))
            if len(candidates) == 1 and self.tree.last[candidates[0]] - self.tree.first[candidates[0]] == 1:
                yield node, int(self.tree.order[self.tree.first[candidates[0]]]), int(a), None
            elif node >= leaves:
                entries = self.members(candidates)
                yield node, None, int(a), entries[np.argmin(squared_distances(part.points[a:b], self.entries[entries]), axis=1)]
            else:
                below = self.below(candidates, filled)
                todo += [(2 * node + 2, below), (2 * node + 1, below)]

    def below(self, nodes: np.ndarray, filled: np.ndarray) -> np.ndarray:
        inner = nodes[nodes < self.wide]
        children = np.concatenate([nodes[nodes >= self.wide], 2 * inner + 1, 2 * inner + 2])
        return children[filled[children]]

    def add_sums(self, part: Part, counts: np.ndarray, totals: np.ndarray) -> None:
        """Add the part's rows to the counts and totals of their entries."""
        for node, entry, first, numbers in self.walk(part):
            if numbers is None:
                counts[entry] += part.tree.last[node] - first
                totals[entry] += part.sums[node]
            else:
                np.add.at(counts, numbers, 1)
                np.add.at(totals, numbers, part.points[first:first + len(numbers)])

    def numbers(self, part: Part) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row, in the block's own order of rows."""
        found = np.zeros(len(part.points), dtype=np.int64)
        for node, entry, first, numbers in self.walk(part):
            found[first:part.tree.last[node]] = entry if numbers is None else numbers
        gap = part.points - self.entries[found]
        out, apart = np.empty_like(found), np.empty_like(found)
        out[part.tree.order], apart[part.tree.order] = found, (gap * gap).sum(axis=1)
        return out, apart


def integer_rows(vectors: DataFrame, key: str, label: str, vector: str, scale: int) -> DataFrame:
    """Rows (id, label, weights) with weights floor(scale * x); unusable vectors are dropped."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    weights = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return vectors.where(F.col(vector).isNotNull() & usable).select(
        F.col(key).alias("id"), F.col(label).alias("label"), weights.alias("weights"))


def padded(lists: pa.Array, width: int) -> np.ndarray:
    """Weights as rows of a matrix; components that a vector lacks are 0."""
    sizes = np.asarray(lists.value_lengths())
    out = np.zeros((len(sizes), width), dtype=np.int64)
    if len(sizes) and sizes.sum():
        rows = np.repeat(np.arange(len(sizes)), sizes)
        out[rows, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(lists.flatten())
    return out


def forest(rows: DataFrame, parts: int, width: int, block: int) -> DataFrame:
    """Blocks of rows where they lie: ids, labels and, for each part, its points and tree.

    One row per block; nodes are arrays as bytes, so a round reads trees instead of building them.
    """
    step = width // parts
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)),
        T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)),
        T.StructField("trees", T.ArrayType(T.ArrayType(T.BinaryType())))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for low in range(0, batch.num_rows, block):
                held.append(batch.slice(low, block))
                if sum(x.num_rows for x in held) >= block:
                    yield packed_block(pa.Table.from_batches(held))
                    held = []
        if held and sum(x.num_rows for x in held):
            yield packed_block(pa.Table.from_batches(held))

    def packed_block(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        lists, ids, labels = (table[c].combine_chunks() for c in ("weights", "id", "label"))
        matrix = padded(lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists, width)
        trees = []
        for p in range(parts):
            part = Part.of(np.ascontiguousarray(matrix[:, p * step:(p + 1) * step]))
            trees.append([x.tobytes() for x in (part.points, *part.tree, part.sums)])
        column = lambda x: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays(
            [whole(column(ids)), whole(column(labels)), pa.array([trees], pa.list_(pa.list_(pa.binary())))], ["ids", "labels", "trees"])

    return rows.mapInArrow(build, schema)


def unpacked(held: list[bytes], step: int) -> Part:
    points, order, first, last, low, high, sums = (np.frombuffer(x, dtype=np.int64) for x in held)
    wide = lambda x, n: x.reshape(n, step)
    return Part(wide(points, len(order)), Boxes(order, first, last, wide(low, len(first)), wide(high, len(first))), wide(sums, len(first)))


def next_books(trees: DataFrame, books: list[np.ndarray], step: int) -> list[np.ndarray]:
    """One Lloyd round. What tasks hand on has the size of the codebooks, whatever they read."""
    shared = trees.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        finders = [Assigner(b) for b in books]
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        totals = [np.zeros_like(b) for b in books]
        for batch in batches:
            for held in batch.column(0):
                for p, arrays in enumerate(held.as_py()):
                    finders[p].add_sums(unpacked(arrays, step), counts[p], totals[p])
        for p, (n, sums) in enumerate(zip(counts, totals)):
            used = np.flatnonzero(n)
            size = len(used) * (step + 1)
            places = np.tile(np.arange(-1, step), len(used))  # place -1 holds the count
            values = np.column_stack([n[used], sums[used]]).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (np.full(size, p), np.repeat(used, step + 1), places, values)],
                ["part", "entry", "place", "total"])

    summed = trees.select("trees").mapInArrow(add, "part long, entry long, place long, total long").groupBy(
        "part", "entry", "place").agg(F.sum("total").alias("total"))
    out = [np.concatenate([np.zeros((len(b), 1), dtype=np.int64), b], axis=1) for b in books]
    for row in summed.collect():  # at most as many rows as the codebooks have numbers
        out[row.part][row.entry, row.place + 1] = row.total
    shared.destroy()
    return [np.where(o[:, :1] > 0, o[:, 1:] // np.maximum(o[:, :1], 1), o[:, 1:]) for o in out]


class Codebooks(NamedTuple):
    entries: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and place, with commas between."""
        numbers = [str(x) for book in self.entries for x in book.ravel().tolist()]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 1024,
               parts: int = 4, entries: int = 256, rounds: int = 4, block: int = BLOCK) -> tuple[DataFrame, Codebooks]:
    """Code and error of every vector, and the codebooks they refer to.

    Rows: key, label, ``code`` (two hex digits a part) and ``error`` (squared distances summed over
    the parts). A codebook starts as that part of the ``entries`` smallest rows by key (then by
    vector; null keys last). Each of ``rounds`` rounds replaces an entry by the floor of the mean
    of the parts nearest to it; ties go to the lower number and unused entries stay.

    Vectors that are null or hold a null or non-finite component are dropped. Shorter vectors,
    and a width that ``parts`` does not divide, are filled up with zeros; empty vectors alone give
    code 0 and error 0. Null labels stay null; rows that repeat each count and each get a row;
    with fewer rows than ``entries`` the codebooks are smaller; an empty table gives no rows.
    Other columns are ignored.

    Trees are built where rows lie and written once; a round moves only sums. At most 256 entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code holds two hex digits, so 1 to 256 entries")
    rows = integer_rows(vectors, key, label, vector, scale)
    longest = rows.agg(F.max(F.size("weights"))).first()[0] or 0
    step = -(-longest // parts)
    width = step * parts
    seeds = rows.orderBy(F.asc_nulls_last("id"), "weights").limit(entries).select("weights").collect()
    start = np.zeros((len(seeds), width), dtype=np.int64)
    for i, seed in enumerate(seeds):
        start[i, :len(seed.weights)] = seed.weights
    books = [np.ascontiguousarray(start[:, p * step:(p + 1) * step]) for p in range(parts)]
    schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not seeds:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", key).withColumnRenamed("label", label), Codebooks(books)
    trees = settled(forest(rows, parts, width, block), "trees")
    for _ in range(rounds if width else 0):
        books = next_books(trees, books, step)
    shared = trees.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [Assigner(b) for b in shared.value]
        for batch in batches:
            for ids, labels, held in zip(*(batch.column(c) for c in ("ids", "labels", "trees"))):
                error, digits = np.zeros(len(ids), dtype=np.int64), []
                for p, arrays in enumerate(held.as_py()):
                    number, apart = finders[p].numbers(unpacked(arrays, step))
                    error += apart
                    digits.append(number)
                codes = np.stack(digits, axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())],
                    ["id", "label", "code", "error"])

    coded = trees.mapInArrow(assign, schema)
    return coded.withColumnRenamed("id", key).withColumnRenamed("label", label), Codebooks(books)


def with_label_error(coded: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """Rows with ``label_error``: the errors of all rows of an equal label, nulls together."""
    totals = coded.groupBy(F.col(label).alias("same")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col(label).eqNullSafe(F.col("same"))).select(key, label, "code", "error", "label_error")
