"""Repeated substrings of a corpus, by suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it starts anywhere else too. Equal
strings have equal minimisers (the least hash of the short grams in them), so every maximal run of
string starts with one minimiser, a piece, need only meet the pieces of the same minimiser.
Minimisers that occur once drop out, and equal pieces count as one. Pieces that are left are laid
side by side and their suffixes sorted in two stages: those smaller than their successors are
sorted directly, the others follow from them by scans over the buckets of first bytes. Suffixes
that share ``length`` bytes are then neighbours, and show in their common prefixes.

A minimiser with very many different pieces (a passage that a great part of the corpus holds) is
not laid out in one task: its strings are compared by 128-bit digests, dealt over as many tasks as
it takes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.words import BASE, MASK, VALUES, Texts, blocks, mixed, runs
from weekloom.session import released, settled

GRAM = 32
#: Bits for a place in a block, beside those of its hash, when the first least gram is sought.
PLACE_BITS = 31
#: Bytes whose suffixes are sorted together; pieces of one minimiser always are.
CHUNK = 1 << 18
#: Different pieces of a minimiser beyond which digests take over, and pieces for each of their tasks.
MANY = 64
PER_TASK = 512
BLOCK = 1 << 21


# --- suffixes -------------------------------------------------------------------------------

def suffix_array(pieces: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the pieces in order of their first ``depth`` bytes, at least.

    Returns their places in the joined bytes (a separator follows each piece), the joined bytes
    and for each place the end of its piece.
    """
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    joined = b"\0".join(pieces) + b"\0"
    raw = np.frombuffer(joined, dtype=np.uint8)
    end_of = np.repeat(ends, sizes + 1)
    symbol = raw.astype(np.int16) + 1
    symbol[ends] = 0

    # A suffix is smaller than its successor if the next different symbol is larger.
    n = len(symbol)
    step = np.zeros(n, dtype=np.int16)
    step[:-1] = symbol[1:] - symbol[:-1]
    where = np.where(step != 0, np.arange(n), n - 1)
    where = np.minimum.accumulate(where[::-1])[::-1]
    smaller = step[where] > 0
    smaller[ends] = True

    direct = np.flatnonzero(smaller & (symbol > 0))
    keys = {int(i): joined[i:min(i + depth, e)] for i, e in zip(direct.tolist(), end_of[direct].tolist(), strict=True)}
    direct = np.array(sorted(keys, key=keys.__getitem__), dtype=np.int64)
    first = symbol[direct]
    cuts = np.searchsorted(first, np.arange(258))
    arrived: list[list[np.ndarray]] = [[] for _ in range(258)]
    out = []

    def induce(placed: np.ndarray, bucket: int) -> np.ndarray:
        """Hand the larger predecessors of placed suffixes to their buckets; return those of this one."""
        before = placed[placed > 0] - 1
        before = before[~smaller[before]]
        at = symbol[before]
        own, rest, to = before[at == bucket], before[at != bucket], at[at != bucket]
        if len(rest):
            order = np.argsort(to, kind="stable")
            rest, to = rest[order], to[order]
            begin = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            for low, high in zip(begin, np.append(begin[1:], len(to)), strict=True):
                arrived[to[low]].append(rest[low:high])
        return own

    induce(ends, 0)
    for bucket in range(1, 257):
        # Larger suffixes come first in a bucket, then the directly sorted ones.
        wave = np.concatenate(arrived[bucket]) if arrived[bucket] else np.zeros(0, dtype=np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave, bucket)
        sorted_part = direct[cuts[bucket]:cuts[bucket + 1]]
        if len(sorted_part):
            out.append(sorted_part)
            induce(sorted_part, bucket)
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.int64)), raw, end_of


def common_prefixes(order: np.ndarray, raw: np.ndarray, end_of: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix and the next in order share their first ``length`` bytes (8 or more)."""
    p, q = order[:-1], order[1:]
    alive = np.flatnonzero((end_of[p] - p >= length) & (end_of[q] - q >= length))
    if not len(alive):
        return np.zeros(len(p), dtype=bool)
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for at in [*range(0, length - 8, 8), length - 8]:
        alive = alive[(eight[p[alive] + at] == eight[q[alive] + at]).all(axis=1)]
    out = np.zeros(len(p), dtype=bool)
    out[alive] = True
    return out


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece the places at which a string of ``length`` bytes starts that starts elsewhere
    too, in this piece or another."""
    order, raw, end_of = suffix_array(pieces, length)
    shared = np.flatnonzero(common_prefixes(order, raw, end_of, length))
    places = np.unique(np.concatenate([order[shared], order[shared + 1]]))
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    cuts = np.searchsorted(places, np.append(begin, len(raw)))
    return [places[a:b] - s for a, b, s in zip(cuts[:-1], cuts[1:], begin, strict=True)]


# --- pieces ---------------------------------------------------------------------------------

def gram_hashes(data: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Scrambled hash of the ``n`` bytes that start at each place."""
    values = VALUES if not seed else mixed(VALUES, seed)
    out, done = None, 0
    power, width, base = values[data], 1, int(BASE)
    while True:
        if n & width:
            if out is None:
                out, done = power, width
            else:
                size = len(data) - done - width + 1
                out = out[:size] * np.uint64(base) + power[done:done + size]
                done += width
        if done == n:
            return mixed(out, seed + 1)
        power = power[:-width] * np.uint64(base) + power[width:]
        width, base = width * 2, base * base & MASK


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, from running minima of blocks in both directions."""
    n = len(values)
    size = -(-n // width) * width
    full = np.full(size, np.iinfo(values.dtype).max, dtype=values.dtype)
    full[:n] = values
    grid = full.reshape(-1, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    return np.minimum(ahead[:n - width + 1], behind[width - 1:n])


def pieces_of(texts: Texts, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first start, number of starts and minimiser of every piece of a block."""
    data, offsets = texts.data, texts.offsets
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64)
    gram = min(GRAM, length)
    hashes = gram_hashes(data, gram)
    shift = np.uint64(PLACE_BITS)
    # The hash's high bits before the place: the least of these is the first least gram.
    ranked = (hashes >> shift << shift) | np.arange(len(hashes), dtype=np.uint64)
    first = (sliding_least(ranked, length - gram + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    starts = np.maximum(np.diff(offsets) - length + 1, 0)
    text = np.repeat(np.arange(len(starts)), starts)
    place = np.repeat(offsets[:-1], starts) + runs(starts)
    first = first[place]
    fresh = np.ones(len(place), dtype=bool)
    fresh[1:] = (first[1:] != first[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(fresh)
    sizes = np.diff(np.append(begin, len(place)))
    return text[begin], place[begin] - offsets[text[begin]], sizes, hashes[first[begin]]


PIECE = "key long, tag long, places array<long>, starts int, least long, d1 long, d2 long"


def cut_up(docs: DataFrame, length: int) -> DataFrame:
    """The different pieces of every text: where they start, their minimiser and digest.

    A text that repeats a line over and over has few of them, with many places.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text", BLOCK):
            text, start, starts, least = pieces_of(texts, length)
            low = texts.offsets[text] + start
            raw = memoryview(np.ascontiguousarray(texts.data))
            digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(
                low.tolist(), (low + starts + length - 1).tolist(), strict=True))
            both = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
            order = np.lexsort((start, both[:, 1], both[:, 0], text))
            text, start, starts, least, both = text[order], start[order], starts[order], least[order], both[order]
            fresh = np.ones(len(text), dtype=bool)
            fresh[1:] = (text[1:] != text[:-1]) | (both[1:] != both[:-1]).any(axis=1)
            at = np.flatnonzero(fresh)
            rows = pa.array(text[at])
            yield pa.RecordBatch.from_arrays([
                part["key"].take(rows), part["tag"].take(rows),
                pa.ListArray.from_arrays(pa.array(np.append(at, len(text)).astype(np.int32)), pa.array(start)),
                pa.array(starts[at].astype(np.int32)), pa.array(least[at].view(np.int64)), pa.array(both[at, 0]), pa.array(both[at, 1])],
                ["key", "tag", "places", "starts", "least", "d1", "d2"])

    return docs.mapInArrow(scan, PIECE)


PLACE = ["key", "tag", "start"]
SPANS = "key long, tag long, low array<long>, high array<long>"


def spans_of(starts: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Disjoint spans that strings of ``length`` bytes at the given starts (in order) cover."""
    if not len(starts):
        return [], []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return starts[np.append(0, cut)].tolist(), (starts[np.append(cut - 1, len(starts) - 1)] + length).tolist()


def with_rows(docs: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """Join what was found for texts (key, tag) to their rows; null keys meet null keys."""
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("tag") == F.col("_tag"))
    return docs.join(found.withColumnsRenamed({"key": "_key", "tag": "_tag"}), same, how)


def with_bytes(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """The chosen pieces (key, tag, start, starts, least, others, more) with their bytes."""
    fields = ["start", "starts", "least", "others", "more"]
    wanted = chosen.groupBy("key", "tag").agg(F.collect_list(F.struct(*fields)).alias("pieces"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text", BLOCK):
            rows = []
            for i, (key, tag, pieces) in enumerate(zip(*(part[n].to_pylist() for n in ("key", "tag", "pieces")), strict=True)):
                raw = texts.piece(i)
                rows += [(key, tag, *(p[f] for f in fields), raw[p["start"]:p["start"] + p["starts"] + length - 1]) for p in pieces]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "tag", *fields, "raw"])

    return with_rows(docs, settled(wanted, "wanted-pieces")).select("key", "tag", "text", "pieces").mapInArrow(
        scan, "key long, tag long, start long, starts int, least long, others long, more int, raw binary")


def sorted_spans(pieces: DataFrame, length: int) -> DataFrame:
    """Spans of the pieces whose minimiser has few others, from suffix arrays."""

    def solve(group: list[dict]) -> pa.RecordBatch:
        found = repeated_starts([p["raw"] for p in group], length)
        rows = [(p["key"], p["tag"], *spans_of(s + p["start"], length)) for p, s in zip(group, found, strict=True) if len(s)]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        lists = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), lists, lists), strict=True)],
            ["key", "tag", "low", "high"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in batch.to_pylist():
                if size >= CHUNK and piece["least"] != held[-1]["least"]:
                    yield solve(held)
                    held, size = [], 0
                held.append(piece)
                size += len(piece["raw"])
        if held:
            yield solve(held)

    rows = pieces.select(*PLACE, "least", "raw").repartition("least").sortWithinPartitions("least", *PLACE)
    return rows.mapInArrow(scan, SPANS)


def digest_spans(pieces: DataFrame, length: int) -> DataFrame:
    """Spans of the pieces of minimisers with very many others, from digests of their strings.

    The strings of a minimiser are dealt by digest into ``more`` + 1 lots of bounded size.
    """

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p in batch.to_pylist():
                data = np.frombuffer(p["raw"], dtype=np.uint8)
                one, two = gram_hashes(data, length), gram_hashes(data, length, 5)
                lot = (one % np.uint64(p["more"] + 1)).astype(np.int64)
                for l in np.unique(lot):
                    at = np.flatnonzero(lot == l)
                    rows.append((p["key"], p["tag"], p["start"], p["least"], int(l), at.astype(np.int32).tobytes(),
                                 np.stack([one[at], two[at]], axis=1).tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*PLACE, "least", "lot", "at", "digests"])

    def solve(group: list[dict]) -> pa.RecordBatch:
        digests = np.concatenate([np.frombuffer(p["digests"], dtype=np.uint64).reshape(-1, 2) for p in group])
        order = np.lexsort((digests[:, 1], digests[:, 0]))
        same = (digests[order[1:]] == digests[order[:-1]]).all(axis=1)
        twice = np.zeros(len(digests), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        rows, low = [], 0
        for p in group:
            at = np.frombuffer(p["at"], dtype=np.int32)
            starts = at[twice[low:low + len(at)]].astype(np.int64) + p["start"]
            low += len(at)
            if len(starts):
                rows.append((p["key"], p["tag"], *spans_of(starts, length)))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        lists = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), lists, lists), strict=True)],
            ["key", "tag", "low", "high"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["least"], row["lot"]) != (held[-1]["least"], held[-1]["lot"]):
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    rows = pieces.mapInArrow(
        strings, "key long, tag long, start long, least long, lot int, at binary, digests binary")
    return rows.repartition("least", "lot").sortWithinPartitions("least", "lot", *PLACE).mapInArrow(scan, SPANS)


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(key, tag, low, high): byte spans of the texts (key, tag, text) that repeated strings cover."""
    pieces = settled(cut_up(docs.where(F.octet_length("text") >= length), length), "pieces")
    n = F.sum(F.size("places")).alias("n")
    often = settled(pieces.groupBy("least").agg(n).where("n > 1").select("least"), "minimisers")
    shared = settled(pieces.join(often, "least"), "shared-pieces")
    released(docs.sparkSession)
    name = ["least", "d1", "d2"]
    # Equal pieces are one; any of them stands for all, they have the same bytes.
    distinct = settled(shared.groupBy(*name).agg(
        n, F.first(F.get("places", F.lit(0))).alias("start"), *[F.first(c).alias(c) for c in ("key", "tag", "starts")]), "distinct-pieces")
    equal = settled(distinct.where("n > 1").select(*name), "equal-pieces")
    whole = shared.join(equal, name).select(
        "key", "tag", F.col("places").alias("low"),
        F.transform("places", lambda p: p + F.col("starts") + (length - 1)).alias("high"))
    groups = settled(distinct.groupBy("least").agg(F.count("*").alias("others")).where("others > 1"), "piece-groups")
    unclear = distinct.join(groups, "least").withColumn("more", (F.col("others") / PER_TASK).cast("int"))
    laid = settled(with_bytes(docs, unclear, length), "piece-bytes")
    released(docs.sparkSession)
    return whole.unionByName(sorted_spans(laid.where(F.col("others") <= MANY), length)).unionByName(
        digest_spans(laid.where(F.col("others") > MANY), length))


def merged(low: list[int], high: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as disjoint maximal ones; spans that touch are one."""
    a, b = np.array(low, dtype=np.int64), np.array(high, dtype=np.int64)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    cut = np.flatnonzero(a[1:] > b[:-1]) + 1
    return a[np.append(0, cut)], b[np.append(cut - 1, len(b) - 1)]


def without_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_bytes, kept (the bytes left), n_removed, n_spans.

    Null texts are empty; texts under ``length`` bytes lose nothing; equal rows repeat each
    other, so all their strings go; rows without key, or with a shared one, are documents like
    any; an empty table gives no rows; other columns are ignored. A cut may fall inside a
    character: the result is bytes.
    """
    frame = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "tag", F.xxhash64("text"))
    frame = frame.select("key", "tag", "text")
    spans = repeated_spans(frame, length).groupBy("key", "tag").agg(
        F.flatten(F.collect_list("low")).alias("low"), F.flatten(F.collect_list("high")).alias("high"))
    joined = with_rows(frame, settled(spans, "spans"), "left").select("key", "text", "low", "high")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            rows = []
            for i, (low, high) in enumerate(zip(part["low"].to_pylist(), part["high"].to_pylist(), strict=True)):
                raw = texts.piece(i)
                if not low:
                    rows.append((len(raw), raw, 0, 0))
                    continue
                a, b = merged(low, high)
                keep = b"".join(raw[x:y] for x, y in zip(np.append(0, b).tolist(), np.append(a, len(raw)).tolist(), strict=True))
                rows.append((len(raw), keep, len(raw) - len(keep), len(a)))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part["key"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["key", "n_bytes", "kept", "n_removed", "n_spans"])

    return joined.mapInArrow(scan, "key long, n_bytes long, kept binary, n_removed long, n_spans long").withColumnRenamed("key", key)
