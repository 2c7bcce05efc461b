"""Hard negatives: the best rows of other labels, in a band of scores below each positive.

Anchors are clustered. In each block of rows, and for each cluster, the rows are sorted once by an
upper bound of their score with any member: a row's length times the cosine of its angle to the
cluster's centre less the cluster's widest angle. Every member walks that list, and stops where
the bound proves that nothing further on can enter its result. A first pass of walks finds the
positives, a second one the negatives below them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.llm.sampling import smallest_digests
from weekloom.llm.search import NO_ID, matrix, stretches
from weekloom.session import settled

SAMPLE = 4096
CLUSTERS = 64
MEMBERS = 256
ROWS = 8192
STEP = 256
BATCH_BYTES = 1 << 24
EXACT = 1 << 53


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where these hold them, else in integers."""
    reach = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * max(left.shape[1], 1)
    if reach < EXACT:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    return left @ right.T


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(float) ** 2).sum(axis=1))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    length = lengths(rows)[:, None]
    return rows / np.where(length > 0, length, 1)


def centres(sample: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Unit centres by spherical k-means, from evenly spaced rows of the sample."""
    x = unit(sample)
    held = x[np.linspace(0, len(x) - 1, min(clusters, len(x))).astype(int)]
    for _ in range(rounds):
        nearest = (x @ held.T).argmax(axis=1)
        sums = np.zeros_like(held)
        np.add.at(sums, nearest, x)
        held = np.where((sums != 0).any(axis=1)[:, None], unit(sums), held)
    return held


class Walk:
    """The rows of a block, in the order of their bounds for one cluster of anchors."""

    def __init__(self, members: np.ndarray, rows: np.ndarray):
        self.members, self.reach = members, lengths(members)
        centre = unit(unit(members).sum(axis=0, keepdims=True))[0]
        widest = np.arccos(np.clip(unit(members) @ centre, -1, 1)).max() if self.reach.all() else np.pi
        length = lengths(rows)
        angle = np.arccos(np.clip(unit(rows) @ centre, -1, 1))
        # Above the bound by more than arccos can lose, so that rounding never ends a walk too early.
        bound = length * (np.cos(np.maximum(angle - widest, 0)) + 1e-7)
        self.order = np.argsort(-bound, kind="stable")
        self.bound, self.rows = bound[self.order], rows[self.order]

    def steps(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Growing stretches of the list and the most that each member can score from their start on."""
        low, size = 0, STEP
        while low < len(self.rows):
            high = min(low + size, len(self.rows))
            yield low, high, self.reach * self.bound[low]
            low, size = high, min(size * 2, 4096)


class Best:
    """The k first candidates so far: higher scores, then smaller ids (null ids last)."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.row = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        floor = self.floor()
        if len(score) and floor > -np.inf:
            able = score >= floor
            score, ids, row = score[able], ids[able], row[able]
        if not len(score):
            return
        if len(score) > self.k:
            able = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids, row = score[able], ids[able], row[able]
        score, ids, row = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.row, row)))
        chosen = np.lexsort((row, ids, -score))[:self.k]
        self.score, self.id, self.row = score[chosen], ids[chosen], row[chosen]

    def floor(self) -> float:
        """What a further candidate must score at least."""
        return float(self.score[-1]) if len(self.score) == self.k else -np.inf


class Rows:
    """Columns of a table of rows as arrays; null ids become NO_ID."""

    def __init__(self, table: pa.Table, width: int):
        self.weights = matrix(table["weights"], width)
        self.row, self.label = (np.asarray(table[c].combine_chunks()) for c in ("row", "label"))
        self.id = np.asarray(table["id"].combine_chunks().fill_null(NO_ID))


FOUND = "anchor long, top long, id long, score long, row long"
# A question of an anchor: the scores at most, and at least in hundredths, of what it looks for.
ANY = (None, None)


def walked(rows: Rows, anchors: Rows, group: np.ndarray, asked: list[dict[tuple, Best]], same: bool) -> None:
    """Let the anchors of one cluster walk a block; ``asked`` holds each anchor's questions and best rows."""
    walk = Walk(anchors.weights[group], rows.weights)
    label, row, ids = rows.label[walk.order], rows.row[walk.order], rows.id[walk.order]

    def can(most: float, questions: dict[tuple, Best]) -> bool:
        return any(most >= best.floor() and (least is None or 100 * most >= least) for (_, least), best in questions.items())

    active = np.array([bool(asked[a]) for a in group])
    for low, high, most in walk.steps():
        active &= np.array([go and can(m, asked[a]) for go, m, a in zip(active, most, group)])
        at = np.flatnonzero(active)
        if not len(at):
            break
        for i, scores in zip(at, products(walk.members[at], walk.rows[low:high])):
            own = group[i]
            meant = label[low:high] == anchors.label[own]
            meant = meant & (row[low:high] != anchors.row[own]) if same else ~meant
            for (top, least), best in asked[own].items():
                held = meant if top is None else meant & (scores <= top) & (100 * scores >= least)
                if held.any():
                    best.add(scores[held], ids[low:high][held], row[low:high][held])


def partial_results(rows: DataFrame, anchors: pa.Table, groups: np.ndarray, questions: list[list[tuple]], width: int,
                    k: int, same: bool, block: int) -> DataFrame:
    """The k best of each task's rows for each question: (anchor, top, id, score, row). Rows stay where they lie."""
    shared = rows.sparkSession.sparkContext.broadcast((anchors, groups, questions))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, numbers, questions = shared.value
        asking = Rows(table, width)
        members = [np.flatnonzero(numbers == g) for g in np.unique(numbers)]
        asked = [{q: Best(k) for q in own} for own in questions]
        for part in stretches(batches, block):
            held = Rows(part, width)
            for group in members:
                walked(held, asking, group, asked, same)
        out = [(asking.row[a], q[0], best) for a, own in enumerate(asked) for q, best in own.items() if len(best.score)]
        if out:
            size = [len(best.score) for *_, best in out]
            ids = np.concatenate([best.id for *_, best in out])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([a for a, *_ in out], size), pa.int64()),
                 pa.array([top for (_, top, _), n in zip(out, size) for _ in range(n)], pa.int64()),
                 pa.array(ids, pa.int64(), mask=ids == NO_ID),
                 pa.array(np.concatenate([best.score for *_, best in out]), pa.int64()),
                 pa.array(np.concatenate([best.row for *_, best in out]), pa.int64())],
                ["anchor", "top", "id", "score", "row"])

    return rows.select("row", "id", "label", "weights").mapInArrow(scan, FOUND)


def labelled_rows(vectors: DataFrame, key: str, vector: str, label: str, scale: int, relabelled: Column | None) -> DataFrame:
    """Rows (row, id, label, weights): usable rows with weights floor(scale * x); ``row`` tells equal rows apart."""
    named = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return named.where(F.col("label").isNotNull() & F.col("v").isNotNull() & usable).select(
        F.monotonically_increasing_id().alias("row"), "id",
        (F.col("label") if relabelled is None else relabelled.cast("long")).alias("label"),
        F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("weights"))


def clustered(anchors: DataFrame, n: int, width: int, clusters: int, members: int, per_batch: int) -> tuple[DataFrame, int]:
    """Anchors with ``piece`` (at most about ``members`` of one cluster) and ``batch``; and the number of batches.

    Centres are fitted on at most SAMPLE anchors; all anchors are assigned. They only decide who
    walks a list together, so results do not depend on them.
    """
    drawn = smallest_digests(anchors, "row", SAMPLE).select("weights").toArrow()
    held = centres(matrix(drawn["weights"], width), max(1, min(clusters, n // 16)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (unit(matrix(pa.chunked_array([batch["weights"]]), width)) @ held.T).argmax(axis=1)
            yield batch.append_column("cluster", pa.array(near, pa.int32()))

    placed = anchors.mapInArrow(assign, T.StructType([*anchors.schema.fields, T.StructField("cluster", T.IntegerType())]))
    sizes = {r.cluster: r["count"] for r in placed.groupBy("cluster").count().collect()}  # at most ``clusters`` rows
    pieces = [-(-sizes.get(c, 0) // members) for c in range(len(held))]
    before = np.concatenate([[0], np.cumsum(pieces)]).tolist()
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    piece = of(before[:-1]) + F.pmod(F.xxhash64("row"), of([max(p, 1) for p in pieces])).cast("int")
    each = max(1, per_batch // members)
    return placed.withColumn("piece", piece).withColumn("batch", F.floor(F.col("piece") / each).cast("int")), -(-before[-1] // each)


def hard_negatives(vectors: DataFrame, is_anchor: Column, k_positives: int = 5, k_negatives: int = 5, share: int = 80,
                   key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
                   relabelled: Column | None = None, clusters: int = CLUSTERS, members: int = MEMBERS, block: int = ROWS,
                   batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Hard negatives of each anchor and positive.

    ``is_anchor`` selects the anchors by the column ``id``, ``relabelled`` gives other labels by
    ``id`` and ``label``. A score is the inner product of integer weights floor(scale * x). An
    anchor's positives are its ``k_positives`` first other rows of its label; for each of them the
    ``k_negatives`` first rows of other labels with share% of its score <= score <= its score are
    returned. Higher scores come first, ties by smaller id, null ids last.

    Rows: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows with a null label, a null vector, or a null or non-finite component take no part.
    Components that a shorter vector lacks are zeros. Rows that share an id, or are equal, are
    rows of their own: an anchor leaves out itself alone, and equal anchors each have their rows.
    A null id is never an anchor but may be a positive or a negative. A positive score below 0 has
    an empty band. An empty table, or no anchor, gives no rows; other columns are ignored. Scores
    must fit a long.

    Anchors are broadcast in batches of ``batch_bytes``; the rows of all tasks meet them where they
    lie, and only each task's best rows are shuffled.
    """
    spark = vectors.sparkSession
    rows = settled(labelled_rows(vectors, key, vector, label, scale, relabelled), "rows")
    chosen = rows.where(is_anchor)
    size = rows.select("id", F.size("weights").alias("w")).agg(F.max("w").alias("w"), F.count_if(is_anchor).alias("n")).first()
    width, empty = size.w or 0, spark.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not size.n:
        return empty
    per_batch = max(members, batch_bytes // (8 * max(width, 1)))
    anchors, batches = clustered(chosen, size.n, width, clusters, members, per_batch)
    anchors = settled(anchors, "anchors")

    def ranked(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("anchor", "top").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def passes(asking: DataFrame, questions: Callable[[pa.Table], list[list[tuple]]], k: int, same: bool) -> DataFrame:
        found = []
        for number in range(batches):
            batch = asking.where(F.col("batch") == number).toArrow()  # bounded by batch_bytes
            if batch.num_rows:
                found.append(partial_results(rows, batch, np.asarray(batch["piece"]), questions(batch), width, k, same, block))
        return settled(found, "walked") if found else spark.createDataFrame([], FOUND)

    positives = settled(ranked(passes(anchors, lambda t: [[ANY]] * t.num_rows, k_positives, True), k_positives).select(
        "anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = positives.where("positive_score >= 0").groupBy("anchor").agg(F.collect_set("positive_score").alias("tops"))
    asking = settled(anchors.join(scores, F.col("row") == F.col("anchor")).drop("anchor"), "asking")
    bands = lambda t: [[(p, share * p) for p in sorted(own.as_py())] for own in t["tops"]]
    negatives = ranked(passes(asking, bands, k_negatives, False), k_negatives).select(
        "anchor", F.col("top").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(negatives, ["anchor", "positive_score"]).join(
        anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select(empty.columns)
