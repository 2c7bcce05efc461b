"""A probabilistic suffix tree over texts, and the unigram score it is compared with.

A text is its lower-cased words joined by single blanks and closed by an end mark; the symbols
are the bytes of that string. Counts of all byte sequences up to a length are gathered from the
whole training part. A context becomes a state of the tree if it is common enough and if what
follows it differs from what follows its own suffix by more than the difference costs to describe.
Distributions are smoothed by the one of the next shorter context; a text is scored by the longest
state that ends at each place. The number of contexts is bounded by their least share, so the
tree keeps its size however large the corpus is.

Word counts have no such bound. Documents are dealt into blocks; every block gets the counts of its
own words by a join, and its documents and counts meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.words import IN_WORD, LOWER, Texts, blocks, runs, split
from weekloom.session import released, settled

DEPTH = 5
END = 0x0A
BLANK = 0x20
#: Least share of all places that a context must have.
LEAST_SHARE = 5e-7
#: Weight of the shorter context's distribution, in counts.
PRIOR = 4.0
BLOCK_BYTES = 48 << 20
#: Distinct sequences that a counting task holds before it hands them on.
HELD = 1_500_000
CACHE_BITS = 20
#: Text bytes worked on at a time.
BLOCK = 1 << 20
END_WORD = 0


class Tokens:
    """Words and symbol string of a block of texts."""

    def __init__(self, texts: Texts):
        low = texts.mapped(LOWER)
        starts, ends, self.first = low.words(IN_WORD)
        self.words = low.hashes(starts, ends)
        self.words[self.words == END_WORD] = 1
        sizes = ends - starts
        n = np.diff(self.first)
        # Every text: DEPTH end marks, its words with a blank or the end mark after each; a text
        # without words is one end mark.
        total = np.bincount(np.repeat(np.arange(len(n)), n), weights=sizes + 1, minlength=len(n)).astype(np.int64)
        total = np.maximum(total, 1)
        self.sizes = total
        begin = np.cumsum(total + DEPTH) - total
        self.string = np.full(int((total + DEPTH).sum()), END, dtype=np.uint8)
        ahead = np.cumsum(sizes + 1) - (sizes + 1)
        base = np.repeat(begin - (ahead[self.first[:-1].clip(max=max(len(ahead) - 1, 0))] if len(ahead) else 0), n)
        place = base + ahead
        self.string[np.repeat(place, sizes) + runs(sizes)] = low.data[np.repeat(starts, sizes) + runs(sizes)]
        last = np.zeros(len(place), dtype=bool)
        last[(self.first[1:] - 1)[n > 0]] = True
        self.string[(place + sizes)[~last]] = BLANK
        self.symbols = np.repeat(begin, total) + runs(total)

    def codes(self) -> np.ndarray:
        """For every symbol in order, the symbol and the DEPTH before it as one number."""
        out = np.zeros(len(self.string) - DEPTH, dtype=np.uint64)
        for k in range(DEPTH + 1):
            out <<= np.uint64(8)
            out |= self.string[k:k + len(out)]
        return out[self.symbols - DEPTH]


def tallied(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and their counts."""
    if counts is None:
        values = np.sort(values)
        at = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
        return values[at], np.diff(np.append(at, len(values)))
    order = np.argsort(values, kind="stable")
    values = values[order]
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[at], np.add.reduceat(counts[order], at) if len(at) else np.zeros(0, np.int64)


class Tally:
    """Counts that grow block by block and are handed on when they are many."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, values: np.ndarray) -> None:
        self.parts.append(tallied(values))
        self.size += len(self.parts[-1][0])
        if self.size > HELD:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            values, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts = [tallied(values, counts)]
        self.size = len(self.parts[0][0]) if self.parts else 0
        return self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def full(self) -> bool:
        return self.size > HELD

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merge()
        self.parts, self.size = [], 0
        return out


COUNTS = "kind int, block int, value long, c long"


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of symbol sequences (kind 0) and, by block, of all words (kind 1).

    Words of documents that are not learned from come with count 0.
    """
    sequences, words = Tally(), {}

    def rows(kind: int, block: int, tally: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        values, counts = tally
        n = len(values)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, block, np.int32)),
            pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["kind", "block", "value", "c"])

    for part, texts in blocks(batches, "text", BLOCK):
        tokens = Tokens(texts)
        learn = np.asarray(part["learn"].to_numpy(zero_copy_only=False), dtype=bool)
        block = part["block"].to_numpy()
        many = np.diff(tokens.first)
        of_word, learned = np.repeat(block, many), np.repeat(learn, many)
        for b in np.unique(block):
            held, other = words.setdefault(int(b), (Tally(), Tally()))
            held.add(np.append(tokens.words[(of_word == b) & learned],
                               np.full(int((learn & (block == b)).sum()), END_WORD, np.uint64)))
            other.add(tokens.words[(of_word == b) & ~learned])
            for tally in (held, other):
                if tally.full():
                    yield rows(1, int(b), (lambda v, c, zero: (v, c * 0 if zero else c))(*tally.take(), tally is other))
        sequences.add(tokens.codes()[np.repeat(learn, tokens.sizes)])
        if sequences.full():
            yield rows(0, 0, sequences.take())
    for b, (held, other) in words.items():
        yield rows(1, b, held.take())
        values, counts = other.take()
        yield rows(1, b, (values, counts * 0))
    yield rows(0, 0, sequences.take())


def contexts(sequences: DataFrame, total: int, least_share: float) -> DataFrame:
    """(depth, code, c): what follows every common enough context, and how often, at each depth.

    At most 1 / least_share contexts of a depth are common enough.
    """
    least = max(2, int(np.ceil(least_share * total)))
    level, out = sequences.groupBy("value").agg(F.sum("c").alias("c")), None
    for depth in range(DEPTH, -1, -1):
        level = settled(level, "sequences")
        by = level.groupBy(F.shiftrightunsigned("value", 8).alias("context")).agg(F.sum("c").alias("n"))
        common = settled(by.where(F.col("n") >= least).select("context"), "contexts")
        rows = level.withColumn("context", F.shiftrightunsigned("value", 8)).join(common, "context", "left_semi").select(
            F.lit(depth).alias("depth"), F.col("value").alias("code"), "c")
        out = rows if out is None else out.unionByName(rows)
        mask = (1 << (8 * depth)) - 1
        level = level.groupBy(F.col("value").bitwiseAND(F.lit(mask)).alias("value")).agg(F.sum("c").alias("c"))
    return out


class Tree:
    """States with smoothed distributions, as sorted arrays for each depth."""

    def __init__(self, depth: np.ndarray, code: np.ndarray, count: np.ndarray):
        self.levels = []
        below = None
        for d in range(DEPTH + 1):
            at = depth == d
            codes, counts = code[at].astype(np.uint64), count[at].astype(np.float64)
            order = np.argsort(codes)
            codes, counts = codes[order], counts[order]
            context = codes >> np.uint64(8)
            names, first = np.unique(context, return_index=True)
            totals = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
            sizes = np.diff(np.append(first, len(codes)))
            if below is None:
                shorter = np.full(len(codes), 1 / 256)
            else:
                shorter = 10 ** self.deeper(codes, d - 1)
            smooth = (counts + PRIOR * shorter) / (np.repeat(totals, sizes) + PRIOR)
            gain = counts * np.log2(counts / np.repeat(totals, sizes) / shorter)
            gained = np.add.reduceat(gain, first) if len(first) else np.zeros(0)
            # Divergence from the shorter context, against what the distribution costs in bits.
            state = gained > sizes * np.log2(totals + 1) / 2 if d else np.ones(len(names), dtype=bool)
            self.levels.append((codes, np.log10(smooth), names, np.log10(PRIOR / (totals + PRIOR)), state))
            below = d
        self.none = -np.log10(256.0)

    def deeper(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """log10 of the smoothed probability of each code's last symbol after its last ``depth``."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for d in range(depth, -1, -1):
            known, values, names, miss, _ = self.levels[d]
            own = codes[left] & np.uint64((1 << (8 * (d + 1))) - 1)
            place = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
            hit = known[place] == own if len(known) else np.zeros(len(own), dtype=bool)
            out[left[hit]] += values[place[hit]]
            left, own = left[~hit], own[~hit] >> np.uint64(8)
            if not len(left):
                return out
            if len(names):
                place = np.minimum(np.searchsorted(names, own), len(names) - 1)
                seen = names[place] == own
                out[left[seen]] += miss[place[seen]]
        out[left] += -np.log10(256.0)
        return out

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each code's last symbol, by the longest state that precedes it."""
        out, left = np.empty(len(codes)), np.arange(len(codes))
        for d in range(DEPTH, -1, -1):
            _, _, names, _, state = self.levels[d]
            if not len(names):
                continue
            own = (codes[left] >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)
            place = np.minimum(np.searchsorted(names, own), len(names) - 1)
            found = (names[place] == own) & state[place]
            out[left[found]] = self.deeper(codes[left[found]], d)
            left = left[~found]
        out[left] = -np.log10(256.0)
        return out


class Cached:
    """Scores of codes, of which the ones met lately are kept."""

    def __init__(self, tree: Tree):
        self.tree = tree
        self.keys = np.full(1 << CACHE_BITS, (1 << 64) - 1, dtype=np.uint64)
        self.values = np.zeros(1 << CACHE_BITS)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        slot = (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)
        missing = np.flatnonzero(self.keys[slot] != codes)
        out = self.values[slot]
        if len(missing):
            distinct, _ = tallied(codes[missing])
            scores = self.tree.scores(distinct)
            out[missing] = scores[np.searchsorted(distinct, codes[missing])]
            at = (distinct * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)
            self.keys[at], self.values[at] = distinct, scores
        return out


def suffix_tree_scores(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text",
                       least_share: float = LEAST_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: key, held_out, n_tokens (words and one end), n_known (tokens that occur in the
    training part), train_tokens, base_score (unigrams, add-one) and score (the tree's), both
    log10 probabilities of the whole text.

    Documents with ``held_out`` are not learned from; where it is null they are. Null texts are
    empty: one end mark. Rows that share a key are scored and learned from one by one. Without
    training documents the tree is uniform over bytes. An empty table gives no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    frame = docs.select(
        F.col(key).alias("key"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    size = frame.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    n_blocks = max(1, -(-size // block_bytes))
    frame = frame.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int"))
    dealt = frame.select("block", (~F.col("held")).alias("learn"), "text").repartition(n_blocks, "block")
    counts = settled(dealt.mapInArrow(counted, COUNTS), "counts")
    released(spark)

    sequences = counts.where("kind = 0").select("value", "c")
    total = sequences.agg(F.sum("c").alias("n")).first().n or 0
    found = contexts(sequences, total, least_share).toArrow()
    tree = Tree(*(found[n].to_numpy() for n in ("depth", "code", "c")))
    shared = spark.sparkContext.broadcast(tree)

    # One row for each block and word; a common word has no more rows than there are blocks.
    by = Window.partitionBy("value")
    words = counts.where("kind = 1").groupBy("value", "block").agg(F.sum("c").alias("c"))
    words = settled(words.select(
        "block", "value", "c", F.sum("c").over(by).alias("total"),
        F.row_number().over(by.orderBy("block")).alias("nth")), "word-counts")
    sums = words.agg(F.sum("c").alias("n"), F.count_if((F.col("nth") == 1) & (F.col("total") > 0)).alias("v"),
                     F.max(F.when(F.col("value") == END_WORD, F.col("total"))).alias("end")).first()
    tokens, distinct, ends = sums.n or 0, sums.v or 0, sums.end or 0
    released(spark)

    rows = words.where("total > 0").select(
        "block", F.lit(0).alias("kind"), F.col("value").alias("value"), F.col("total").alias("c"),
        F.lit(None).cast("long").alias("key"), F.lit(None).cast("boolean").alias("held"), F.lit(None).cast("string").alias("text"))
    rows = rows.unionByName(frame.select(
        "block", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("value"), F.lit(None).cast("long").alias("c"),
        "key", "held", "text")).repartition(n_blocks, "block").sortWithinPartitions("block", "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = Cached(shared.value)
        own, at = [], None
        values, logs = np.zeros(0, np.uint64), np.zeros(0)
        floor = np.log10(tokens + distinct + 1)
        for batch in batches:
            block, kind = batch["block"].to_numpy(), batch["kind"].to_numpy()
            cuts = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])))
            for low, high in zip(cuts, np.append(cuts[1:], len(block)), strict=True):
                piece = batch.slice(int(low), int(high - low))
                if block[low] != at:
                    own, at = [], block[low]
                    values, logs = np.zeros(0, np.uint64), np.zeros(0)
                if kind[low] == 0:
                    own.append((piece["value"].to_numpy().view(np.uint64), piece["c"].to_numpy()))
                    continue
                if own:
                    v, c = (np.concatenate(x) for x in zip(*own, strict=True))
                    order = np.argsort(v)
                    values, logs, own = v[order], np.log10(c[order] + 1.0), []
                for part, texts in split(piece, piece["text"], BLOCK):
                    tokens_of = Tokens(texts)
                    if len(values):
                        place = np.minimum(np.searchsorted(values, tokens_of.words), len(values) - 1)
                        known = values[place] == tokens_of.words
                        gains = np.where(known, logs[place], 0.0)
                    else:
                        known, gains = np.zeros(len(tokens_of.words), dtype=bool), np.zeros(len(tokens_of.words))
                    first = tokens_of.first
                    n = np.diff(first) + 1
                    total = np.append(0.0, np.cumsum(gains))
                    seen = np.append(0, np.cumsum(known))
                    base = total[first[1:]] - total[first[:-1]] + np.log10(ends + 1.0) - n * floor
                    score = np.append(0.0, np.cumsum(cached(tokens_of.codes())))
                    bounds = np.append(0, np.cumsum(tokens_of.sizes))
                    yield pa.RecordBatch.from_arrays([
                        part["key"], part["held"], pa.array(n.astype(np.int64)),
                        pa.array((seen[first[1:]] - seen[first[:-1]] + (1 if ends else 0)).astype(np.int64)),
                        pa.array(np.full(len(n), tokens, np.int64)), pa.array(base),
                        pa.array(score[bounds[1:]] - score[bounds[:-1]])],
                        ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(scan, "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                 "base_score double, score double").withColumnRenamed("key", key)

