"""Benchmark passages in documents: a prefix-filtered set join with exact verification.

Every run of ``n`` words of a benchmark item is a window, seen as a set of short word shingles.
A document holds the window only if it holds all of them, so one shingle, the rarest in the corpus,
is the necessary prefix. Documents meet windows on that token alone; the shingle's place must
leave room for the window on both sides (length and position), and the survivors are compared
word by word over the whole window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.words import LOWER, Texts, blocks, joined, runs, separators
from weekloom.session import settled

# Separators between words: all of ASCII but digits and letters.
ALNUM = separators(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
SHINGLE = 3
FILTER_BITS = 22


class Lookup:
    """Places of 64-bit values in a sorted list. Most values that are absent fail at a bit table."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.seen[self.values >> np.uint64(64 - FILTER_BITS)] = True

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the asked values that are listed, and their places in the list."""
        if not len(self.values):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        near = np.flatnonzero(self.seen[asked >> np.uint64(64 - FILTER_BITS)])
        place = np.minimum(np.searchsorted(self.values, asked[near]), len(self.values) - 1)
        hit = self.values[place] == asked[near]
        return near[hit], place[hit]


def words_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block and where each text's words begin. Words are ASCII-lower-cased."""
    low = texts.mapped(LOWER)
    starts, ends, first = low.words(ALNUM)
    return low.hashes(starts, ends), first


class Windows:
    """All windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n = n
        members: dict[bytes, set[int]] = {}
        for item, text in items:
            raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
            words, _ = words_of(Texts(raw, np.array([0, len(raw)])))
            for at in range(max(len(words) - n + 1, min(len(words), 1))):
                members.setdefault(words[at:at + n].tobytes(), set()).add(item)
        self.items = [sorted(v) for v in members.values()]
        self.sizes = np.array([len(k) // 8 for k in members], dtype=np.int64)
        self.words = np.zeros((len(members), n), dtype=np.uint64)
        for row, key in zip(self.words, members, strict=True):
            row[:len(key) // 8] = np.frombuffer(key, dtype=np.uint64)

    def shingles(self) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Windows (indices), their shingles (a row each) and the shingle's number of words."""
        out = []
        for size in np.unique(self.sizes):
            which = np.flatnonzero(self.sizes == size)
            n = min(SHINGLE, int(size))
            out.append((which, np.stack([joined(self.words[w, :size], n) for w in which]), n))
        return out


def rarity(docs: DataFrame, text: str, listed: dict[int, Lookup]) -> dict[int, np.ndarray]:
    """How often each listed shingle occurs in all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(listed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        counts = {n: np.zeros(len(t.values), dtype=np.int64) for n, t in tables.items()}
        for _, texts in blocks(batches, text):
            words, first = words_of(texts)
            for n, table in tables.items():
                at, place = table.find(joined(words, n))
                inside = np.searchsorted(first, at, side="right") == np.searchsorted(first, at + n - 1, side="right")
                counts[n] += np.bincount(place[inside], minlength=len(table.values))
        for n, c in counts.items():
            held = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(held), n, np.int32)), pa.array(held), pa.array(c[held])], ["n", "place", "c"])

    counted = docs.select(text).mapInArrow(count, "n int, place long, c long").groupBy("n", "place").agg(F.sum("c").alias("c"))
    out = {n: np.zeros(len(t.values), dtype=np.int64) for n, t in listed.items()}
    for r in counted.toLocalIterator():  # no more rows than the block of items has shingles
        out[r.n][r.place] = r.c
    return out


class Index:
    """Windows by their rarest shingle: for every size of shingle a lookup and its window lists."""

    def __init__(self, windows: Windows, listed: dict[int, Lookup], counts: dict[int, np.ndarray]):
        self.windows = windows
        self.tables: dict[int, tuple[Lookup, np.ndarray, np.ndarray, np.ndarray]] = {}
        chosen: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for which, rows, n in windows.shingles():
            places = np.searchsorted(listed[n].values, rows)
            # Rarity first, then the value, is one order for all windows.
            seen = counts[n][places]
            value = np.where(seen == seen.min(axis=1, keepdims=True), rows, np.uint64((1 << 64) - 1))
            at = value.argmin(axis=1)
            chosen.setdefault(n, []).append((rows[np.arange(len(rows)), at], which, at))
        for n, parts in chosen.items():
            token, which, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(token, kind="stable")
            table = Lookup(token)
            begin = np.searchsorted(token[order], table.values)
            self.tables[n] = table, np.append(begin, len(order)), which[order], offset[order]

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions of window occurrences and the windows."""
        starts, found = [], []
        ends_of = first[1:]
        for n, (table, begin, which, offset) in self.tables.items():
            at, place = table.find(joined(words, n))
            sizes = begin[place + 1] - begin[place]
            row = np.repeat(begin[place], sizes) + runs(sizes)
            window, start = which[row], np.repeat(at, sizes) - offset[row]
            text = np.searchsorted(first, np.repeat(at, sizes), side="right") - 1
            size = self.windows.sizes[window]
            room = (start >= first[text]) & (start + size <= ends_of[text])
            window, start, size = window[room], start[room], size[room]
            for low in range(0, len(window), 1 << 16):
                w, s = window[low:low + (1 << 16)], start[low:low + (1 << 16)]
                same = np.ones(len(w), dtype=bool)
                for k in range(self.windows.n):
                    inside = k < size[low:low + (1 << 16)]
                    same &= ~inside | (words[np.minimum(s + k, len(words) - 1)] == self.windows.words[w, k])
                starts.append(s[same])
                found.append(w[same])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(found)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text",
                   item: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """Per document: ``key``, the text, n_words, starts and ends (word places, disjoint runs that
    occurrences cover) and items (ids with occurring windows).

    The benchmark is worked through in blocks of about ``block_bytes``, so that what is sent to
    every task keeps its size however many items there are. Null texts have no words; items
    without words have no windows; repeated documents, and documents without id, each get a row;
    items that share an id are one item, as are all items without id.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length(item_text)).alias("b")).first().b or 0
    n_blocks = max(1, -(-size // block_bytes))
    state = docs.select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.lit(0).alias("n_words"),
        F.expr("cast(array() as array<int>)").alias("starts"), F.expr("cast(array() as array<int>)").alias("ends"),
        F.expr("cast(array() as array<bigint>)").alias("items"))
    schema = state.schema
    for b in range(n_blocks):
        part = benchmark.where(F.pmod(F.xxhash64(item), F.lit(n_blocks)) == b)
        windows = Windows([tuple(r) for r in part.select(item, item_text).toLocalIterator()], n)
        values: dict[int, list[np.ndarray]] = {}
        for _, rows, s in windows.shingles():
            values.setdefault(s, []).append(rows.ravel())
        listed = {s: Lookup(np.concatenate(v)) for s, v in values.items()}
        index = Index(windows, listed, rarity(docs, text, listed))
        shared = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for part, texts in blocks(batches, "text"):
                words, first = words_of(texts)
                start, window = index.hits(words, first)
                spans = {i: list(zip(a, b, strict=True)) if a else [] for i, (a, b) in enumerate(
                    zip(part["starts"].to_pylist(), part["ends"].to_pylist(), strict=True))}
                items = [set(x) for x in part["items"].to_pylist()]
                where = np.searchsorted(first, start, side="right") - 1
                base = first[where]
                for t, w, low in zip(where.tolist(), window.tolist(), (start - base).tolist(), strict=True):
                    spans[t].append((low, low + int(index.windows.sizes[w])))
                    items[t].update(index.windows.items[w])
                runs_of = [merged(spans[i]) for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([
                    part["key"], part["text"], pa.array(np.diff(first).astype(np.int32)),
                    pa.array([[a for a, _ in r] for r in runs_of], pa.list_(pa.int32())),
                    pa.array([[z for _, z in r] for r in runs_of], pa.list_(pa.int32())),
                    pa.array([sorted(x, key=lambda i: (i is None, i or 0)) for x in items], pa.list_(pa.int64()))], part.schema.names)

        state = state.mapInArrow(scan, schema)
        if b + 1 < n_blocks:
            state = settled(state, "benchmark-hits")
    return state.withColumnRenamed("key", key)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id", **names) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items_sha256 and contaminated.

    See ``benchmark_hits`` for nulls, empty texts and repeated rows; without hits the digest is
    that of an empty string. The item without id counts in n_items and has no place in the digest.
    """
    hits = benchmark_hits(docs, benchmark, n, key, **names)
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0), lambda a, v: a + v).cast("long")
    return hits.select(
        key, F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(listed, "UTF-8"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns.

    What a document holds depends on its text alone, so texts are what is dropped: rows without id
    and rows that share one are judged each by its own text. Null texts stay; repeated rows stay
    or go together; an empty table stays empty.
    """
    hits = benchmark_hits(docs, benchmark, n, key, text, **names).where(F.size("starts") > 0)
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    held = hits.select(digest(F.col("text")).alias("held")).distinct()
    return docs.join(held, digest(F.col(text)) == F.col("held"), "left_anti")
