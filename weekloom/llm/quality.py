"""Quality of texts by supervised subword embeddings.

Words, pairs of words and short byte sequences inside words are hashed into a table of vectors.
A document is the average of its features' vectors; a softmax layer over it gives the class.
Vectors and layer are trained together by stochastic gradient descent in numpy on a bounded
sample of labelled rows; scoring runs over all rows in Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.sampling import smallest_digests
from weekloom.llm.words import BASE, IN_WORD, VALUES, Texts, blocks, joined, mixed

BITS = 16
#: Bounds of the sample that a model is fitted on: rows, and text bytes taken of each class in turn.
SAMPLE_ROWS = 3000
GRAMS = (3,)


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts of a block, in order, and where each text's features begin.

    Words keep their case, since shouting is a sign of quality. Byte sequences cover whole words
    with their borders; characters outside ASCII take several bytes.
    """
    starts, ends, first = texts.words(IN_WORD)
    words = texts.hashes(starts, ends)
    shift = np.uint64(64 - BITS)
    kinds: list[tuple[np.ndarray, np.ndarray]] = [
        ((mixed(words, 1) >> shift).astype(np.int32), first),
        _within((joined(words, 2) >> shift).astype(np.int32), first, 2)]
    data, offsets = texts.data, texts.offsets
    for n in GRAMS:
        if len(data) < n:
            continue
        sums = np.zeros(len(data) - n + 1, dtype=np.uint64)
        for k in range(n):
            sums *= BASE
            sums += VALUES[data[k:k + len(sums)]]
        sums *= np.uint64(0x9E3779B97F4A7C15)
        kinds.append(_within((sums >> shift).astype(np.int32), offsets, n))
    total = sum(b for _, b in kinds)
    out = np.empty(int(total[-1]), dtype=np.int32)
    at = total[:-1].copy()
    for values, begin in kinds:
        sizes = np.diff(begin)
        place = np.repeat(at - begin[:-1], sizes) + np.arange(len(values))
        out[place] = values
        at += sizes
    return out, total


def _within(values: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keep the runs of ``n`` that lie inside one text; where each text's runs begin."""
    keep = np.ones(len(values), dtype=bool)
    for k in range(1, n):
        across = first[1:-1] - k
        keep[across[(across >= 0) & (across < len(values))]] = False
    sizes = np.maximum(np.diff(first) - n + 1, 0)
    # A text shorter than n has no run; its places lie among those cut above.
    return values[keep], np.concatenate([[0], np.cumsum(sizes)])


@dataclass
class Model:
    """Vectors of all hashed features, and the softmax layer for the two classes."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        """For each feature the difference of the two classes' logits: the average of these plus
        the bias equals the logits' difference of the averaged vectors."""
        gap = self.layer[:, 1] - self.layer[:, 0]
        return (self.vectors @ gap).astype(np.float32), float(self.bias[1] - self.bias[0])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int = 16, epochs: int = 8, batch: int = 16,
        rate: float = 0.1, seed: int = 7) -> Model:
    """Minimise the cross entropy by stochastic gradient descent.

    Steps fall with the number of steps done and, per feature, with the gradients it has had
    (so that rare features learn as well as common ones).

    ``rows`` hold distinct feature numbers, their shares of the document (sum 1) and the label.
    """
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / size, 1 / size, (1 << BITS, size)).astype(np.float32)
    layer = random.uniform(-1, 1, (size, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    had = np.full(1 << BITS, 1e-8, dtype=np.float32)
    labels = np.array([r[2] for r in rows], dtype=np.int64)
    steps, done = max(1, epochs * -(-len(rows) // batch)), 0
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for low in range(0, len(rows), batch):
            chosen = [rows[i] for i in order[low:low + batch]]
            now = rate * (1 - done / steps)
            done += 1
            sizes = np.array([len(r[0]) for r in chosen])
            held = np.flatnonzero(sizes)
            which = np.concatenate([r[0] for r in chosen])
            share = np.concatenate([r[1] for r in chosen]).astype(np.float32)
            means = np.zeros((len(chosen), size), dtype=np.float32)
            if len(held):
                begin = (np.cumsum(sizes) - sizes)[held]
                means[held] = np.add.reduceat(vectors[which] * share[:, None], begin, axis=0)
            logits = means @ layer + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True)
            error[np.arange(len(chosen)), labels[order[low:low + batch]]] -= 1
            down = error @ layer.T
            layer -= now * means.T @ error / len(chosen)
            bias -= now * error.sum(axis=0) / len(chosen)
            step = down[np.repeat(np.arange(len(chosen)), sizes)] * share[:, None]
            by = np.argsort(which, kind="stable")
            distinct, at = np.unique(which[by], return_index=True)
            if len(distinct):
                step = np.add.reduceat(step[by], at, axis=0)
                had[distinct] += np.square(step).mean(axis=1)
                vectors[distinct] -= now * step / np.sqrt(had[distinct])[:, None]
    return Model(vectors, layer, bias)


def sample(docs: DataFrame, labels: DataFrame, rows: int, key: str, text: str, label: str) -> DataFrame:
    """At most ``rows`` labelled documents, those with the smallest digests of their keys.

    Where a key has several labels the smallest stands; of repeated documents one.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.min(label).alias("label"))
    drawn = smallest_digests(known, "key", rows)
    # The broadcast side has at most ``rows`` rows of two numbers.
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(drawn), "key")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of each labelled text with their shares, as bytes."""
    for part, texts in blocks(batches, "text"):
        found, first = features(texts)
        places, shares = [], []
        for i in range(len(texts)):
            which, n = np.unique(found[first[i]:first[i + 1]], return_counts=True)
            places.append(which.astype(np.int32).tobytes())
            shares.append((n / max(n.sum(), 1)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [part["key"], part["label"], pa.array(places, pa.binary()), pa.array(shares, pa.binary())],
            ["key", "label", "places", "shares"])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text",
          label: str = "quality", **settings) -> Model:
    """Fit a model on at most ``rows`` labelled documents (a documented bound: about 20 kB each
    reach the driver as counted features, in key order, so that the same rows give the same model).
    """
    drawn = sample(docs, labels, rows, key, text, label)
    got = drawn.mapInArrow(counted, "key long, label int, places binary, shares binary").dropDuplicates(["key"])
    held = sorted(got.collect(), key=lambda r: r.key)
    return fit([(np.frombuffer(r.places, np.int32), np.frombuffer(r.shares, np.float32), r.label) for r in held], **settings)


def probabilities(texts: Texts, gaps: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for each text of a block."""
    found, first = features(texts)
    sums = np.concatenate([[0.0], np.cumsum(gaps[found], dtype=np.float64)])
    mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)
    return 1 / (1 + np.exp(-(mean + bias)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per document: key, score (probability of label 1) and predicted.

    Null and empty texts have no features: their score is that of the layer's bias alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.folded())
    frame = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([part["key"], pa.array(probabilities(texts, *shared.value))], ["key", "score"])

    scored = frame.mapInArrow(scan, frame.drop("text").schema.add("score", "double"))
    return scored.select(F.col("key").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents, with all their columns, whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model.folded())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, text):
            yield part.filter(pa.array(probabilities(texts, *shared.value) >= threshold))

    return docs.mapInArrow(scan, docs.schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows that are kept from learning: CRC-32 of the key as text divisible by 5."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                   threshold: float = 0.3, **settings) -> DataFrame:
    """Per document: key, held_out, score and predicted, by a model of the rows not held out.

    A null key is not held out and has no label. Without labelled rows every score is 0.5; an
    empty table gives no rows; repeated rows each get one; other columns are ignored.
    """
    model = train(docs, labels.where(~held_out(key)), key=key, text=text, **settings)
    return score(docs, model, key, text, threshold).select(
        key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score", "predicted")
