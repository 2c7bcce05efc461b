"""Documents with similar sets of word shingles: a Jaccard join with several global orders.

Two sets of similarity ``t`` or more must share a token among the first n - ceil(t n) + 1 tokens
of each, under whichever global order both are sorted by. The first order, rare tokens first,
makes the candidates: posting lists of prefix tokens, cut by length and position. Candidates must
also share a prefix token under two unrelated orders, and their bitmaps must be near; all of this
is asked before a text moves and sets are compared.

Only connected groups are asked for, so a posting list is not expanded into all its pairs: in
rounds every set meets one set of each of its lists, the smallest at first and then another one
each time; what is then left is joined in full, but only across groups. Equal sets are one set throughout.

Tokens and sets are known by 64-bit digests; among 10^10 different sets about three pairs are
expected to be taken for equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.components import components
from weekloom.llm.words import IN_WORD, LOWER, Texts, blocks, joined, mixed
from weekloom.session import dropped, released, settled

#: Counters of shingles in the whole corpus; they only shape the first order.
SKETCH_BITS = 22
PART = 4096
#: Bits of a set's bitmap. Each token turns one over, so two bitmaps differ in no more bits than
#: their sets in tokens.
BITMAP = 2048
#: Partners that one task compares with a set before the next task takes over.
MEMBERS = 512
#: Rounds in which the sets of a list meet one of them, after the first; they spare the last join pairs.
ROUNDS = 1

#: Bits of the filter that documents pass before their texts move to be compared: 8 MB to broadcast.
FILTER_BITS = 1 << 26
#: Parts, in bits, that hashes of prefix tokens are dealt into, bits of a hash within its part, and bits
#: of the part's filter: 16 MB for all. Hashes that a task holds before it hands them on.
DEALT, WITHIN, FLAGS = 12, 28, 15
HELD = 1 << 22


def shingle_sets(texts: Texts, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Fewer words than ``size`` are one shingle."""
    low = texts.mapped(LOWER)
    starts, ends, first = low.words(IN_WORD)
    words = low.hashes(starts, ends)
    runs = joined(words, size)
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= size:
            found = np.sort(runs[a:b - size + 1])
            keep = np.ones(len(found), dtype=bool)
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        else:
            yield joined(words[a:b], b - a) if b > a else np.zeros(0, dtype=np.uint64)


def digest(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def needed(n, percent: int):
    """Tokens of a set of ``n`` that a partner must share at least."""
    return (percent * n + 99) // 100


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    odd = np.bincount((mixed(tokens, 7) >> np.uint64(53)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def rare_first(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Sort keys of the first order: the level of the token's counter, then scrambled values."""
    return (levels[bucket(tokens)].astype(np.uint64) << np.uint64(58)) | (mixed(tokens, 1) >> np.uint64(6))


def described(frame: DataFrame, size: int, percent: int) -> tuple[DataFrame, np.ndarray]:
    """Per document (key, tag, n, sid: digest of its set, bits: its bitmap, second and third: its
    prefix tokens under these orders), and every counter's level."""
    columns = ["key", "tag", "n", "sid", "bits", "second", "third"]
    schema = "key long, tag long, n int, sid long, bits array<long>, second array<int>, third array<int>, part int, counts binary"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
        for part, texts in blocks(batches, "text"):
            sizes, sids, seen, bits, second, third = [], [], [], [], [], []
            for tokens in shingle_sets(texts, size):
                sizes.append(len(tokens))
                sids.append(digest(tokens))
                seen.append(tokens)
                bits.append(bitmap(tokens))
                second.append(first_of(tokens, 2, percent))
                third.append(first_of(tokens, 3, percent))
            np.add.at(counts, bucket(np.concatenate(seen)), 1)
            held = [pa.array(v, k) for v, k in zip((sizes, sids, bits, second, third), kinds[2:], strict=True)]
            none = pa.nulls(part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part["key"], part["tag"], *held, none.cast(pa.int32()), none.cast(pa.binary())], [*columns, "part", "counts"])
        if counts.any():
            # One byte a counter: what a task has seen 255 times is common wherever the line is drawn.
            rows = [c.tobytes() for c in np.minimum(counts, 255).astype(np.uint8).reshape(-1, PART)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(len(rows), k) for k in kinds), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())],
                [*columns, "part", "counts"])

    found = settled(frame.mapInArrow(scan, schema), "sets")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, row in zip(batch["part"].to_pylist(), batch["counts"], strict=True):
                sums.setdefault(part, np.zeros(PART, dtype=np.int64))
                sums[part] += np.frombuffer(row.as_py(), dtype=np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums, pa.int32()), pa.array([np.minimum(s, (1 << 32) - 1).astype(np.uint32).tobytes() for s in sums.values()], pa.binary())],
            ["part", "counts"])

    # Every task of a part adds up the rows it reads; the parts have one fixed size in total.
    rows = found.where("part is not null").select("part", "counts").repartition("part")
    total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for r in rows.mapInArrow(add, "part int, counts binary").collect():
        total[r.part * PART:(r.part + 1) * PART] += np.frombuffer(r.counts, dtype=np.uint32)
    return found.where("part is null").select(*columns), np.minimum(2 * np.log2(total + 1), 63).astype(np.uint8)


def prefix_tokens(texts: Texts, levels: np.ndarray, size: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text with words: its set, and the set's prefix tokens in the first order."""
    for found in shingle_sets(texts, size):
        if len(found):
            yield found, found[np.argsort(rare_first(found, levels))[:len(found) - needed(len(found), percent) + 1]]


def flags_of(frame: DataFrame, shared: Broadcast, size: int, percent: int) -> np.ndarray:
    """A filter over hashes of prefix tokens: the bits of those that occur in several documents are set.

    Only 4 bytes of each token move, and at most two for a token from what a task holds at a time.
    """

    def deal(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.sort(np.concatenate(held))
        third = np.zeros(len(hashes), dtype=bool)
        np.equal(hashes[2:], hashes[:-2], out=third[2:])
        hashes = hashes[~third]
        parts, begin = np.unique(hashes >> np.uint64(WITHIN), return_index=True)
        low = (hashes & np.uint64((1 << WITHIN) - 1)).astype(np.uint32)
        rows = [r.tobytes() for r in np.split(low, begin[1:])]
        return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(rows, pa.binary())], ["part", "hashes"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, held, size_held = shared.value, [], 0
        for _, texts in blocks(batches, "text"):
            for _, tokens in prefix_tokens(texts, levels, size, percent):
                held.append(token_hashes(tokens))
                size_held += len(tokens)
            if size_held >= HELD:
                yield deal(held)
                held, size_held = [], 0
        if held:
            yield deal(held)

    def flagged(part: int, held: list[bytes]) -> pa.RecordBatch:
        low = np.sort(np.frombuffer(b"".join(held), dtype=np.uint32))
        bits = np.zeros(1 << FLAGS, dtype=np.uint8)
        bits[low[1:][low[1:] == low[:-1]] >> np.uint32(WITHIN - FLAGS)] = 1
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["part", "flags"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for part, row in zip(batch["part"].to_pylist(), batch["hashes"].to_pylist(), strict=True):
                if held and part != at:
                    yield flagged(at, held)
                    held = []
                at = part
                held.append(row)
        if held:
            yield flagged(at, held)

    rows = frame.select("text").mapInArrow(scan, "part int, hashes binary").repartition("part").sortWithinPartitions("part")
    flags = np.zeros(1 << DEALT + FLAGS - 3, dtype=np.uint8)
    width = 1 << FLAGS - 3
    for r in rows.mapInArrow(gather, "part int, flags binary").collect():
        flags[r.part * width:(r.part + 1) * width] = np.frombuffer(r.flags, dtype=np.uint8)
    return flags


def token_hashes(tokens: np.ndarray) -> np.ndarray:
    return mixed(tokens, 11) >> np.uint64(64 - DEALT - WITHIN)


def prefixes(frame: DataFrame, levels: np.ndarray, size: int, percent: int) -> DataFrame:
    """(token, sid, n, at): the prefix tokens of every set under the first order, of tokens that
    occur in several documents, and few others."""
    context = frame.sparkSession.sparkContext
    shared = context.broadcast(levels)
    several = context.broadcast(flags_of(frame, shared, size, percent))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, flags = shared.value, several.value
        for _, texts in blocks(batches, "text"):
            tokens, sids, sizes, places = [], [], [], []
            for found, first in prefix_tokens(texts, levels, size, percent):
                bit = token_hashes(first) >> np.uint64(WITHIN - FLAGS)
                at = np.flatnonzero(flags[bit >> np.uint64(3)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
                if len(at):
                    tokens.append(first[at])
                    sids.append(digest(found))
                    sizes.append(len(found))
                    places.append(at.astype(np.int32))
            if tokens:
                many = np.array([len(t) for t in tokens])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(sids), many)),
                    pa.array(np.repeat(np.array(sizes, dtype=np.int32), many)), pa.array(np.concatenate(places))], ["token", "sid", "n", "at"])

    return frame.select("text").mapInArrow(scan, "token long, sid long, n int, at int")


def long_enough(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def room(n1: Column, at1: Column, n2: Column, at2: Column, percent: int) -> Column:
    """Whether two sets that share tokens at these places can share enough of them."""
    bound = F.least(at1, at2) + 1 + F.least(n1 - at1, n2 - at2) - 1
    return bound * (100 + percent) >= (n1 + n2) * percent


def sifted(frame: DataFrame, asked: DataFrame, by: Sequence[str] = ("key", "tag")) -> DataFrame:
    """The rows of ``frame`` whose columns ``by`` are in ``asked``, and a few others of the same hash.

    The hashes are bits of bitmaps of fixed size in total, so that only rows that are asked for move.
    """
    bit = F.pmod(F.xxhash64(*by), F.lit(FILTER_BITS)) + 1
    maps = asked.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_map"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return frame.withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(maps), "_bucket").where(held).select(frame.columns)


def verified(pairs: DataFrame, nodes: DataFrame, frame: DataFrame, size: int, percent: int) -> DataFrame:
    """Of (x, y), pairs of sets, those that are similar.

    All partners of ``x`` are compared in the tasks that hold its text, in portions of bounded size.
    """
    many = settled(pairs.groupBy("x").agg((F.count("*") / MEMBERS).cast("int").alias("more")), "hubs")
    asked = pairs.select(F.col("x").alias("sid")).unionByName(pairs.select(F.col("y").alias("sid"))).distinct()
    rows = sifted(frame, asked.join(nodes.select("sid", "at.key", "at.tag"), "sid"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            sids = [digest(tokens) for tokens in shingle_sets(texts, size)]
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), part["text"]], ["sid", "text"])

    # The digest is made again, which moves less than a join. Rows that share key and text are read once.
    texts = settled(rows.select("text").mapInArrow(name, "sid long, text string").groupBy("sid").agg(
        F.first("text").alias("text")), "asked-texts")
    released(frame.sparkSession)
    salt = F.pmod(F.xxhash64("y"), F.col("more") + 1).cast("int")
    members = pairs.join(many, "x").select("x", salt.alias("salt"), F.lit(1).alias("kind"), F.col("y").alias("sid"))
    hubs = many.select(
        "x", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("salt"), F.lit(0).alias("kind"), F.col("x").alias("sid"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, at = np.zeros(0, dtype=np.uint64), None
        for part, texts in blocks(batches, "text"):
            left, right = [], []
            columns = (part[n].to_pylist() for n in ("kind", "x", "salt", "sid"))
            for kind, x, salt, sid, tokens in zip(*columns, shingle_sets(texts, size), strict=True):
                if kind == 0:
                    hub, at = tokens, (x, salt)
                    continue
                assert at == (x, salt)
                place = np.minimum(np.searchsorted(hub, tokens), len(hub) - 1)
                common = int((hub[place] == tokens).sum())
                if 100 * common >= percent * (len(hub) + len(tokens) - common):
                    left.append(x)
                    right.append(sid)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["x", "y"])

    rows = hubs.unionByName(members).join(texts, "sid").repartition("x", "salt").sortWithinPartitions("x", "salt", "kind")
    links = settled(rows.mapInArrow(compare, "x long, y long"), "links")
    for table in (many, texts):
        dropped(table)
    return links


def first_of(tokens: np.ndarray, seed: int, percent: int) -> np.ndarray:
    """32 bits of each prefix token of a set under the order that ``seed`` names."""
    keys = mixed(tokens, seed)
    p = len(tokens) - needed(len(tokens), percent) + 1
    keys = np.partition(keys, p - 1)[:p] if 0 < p <= len(keys) else keys
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def groups(docs: DataFrame, size: int, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, tag, n, sid) of every document, tag being a digest of its text, and for each set in a
    group of several documents (sid, stay): the first document of the group, nulls last."""
    frame = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))
    sets, levels = described(frame, size, percent)
    # One row for each distinct set: its first document stands for it. Bitmaps stay in ``sets``.
    nodes = settled(sets.where("n > 0").groupBy("sid").agg(
        F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key", "tag")).alias("at"),
        F.count("*").alias("copies")), "nodes")
    released(frame.sparkSession)
    tokens = settled(prefixes(frame, levels, size, percent).distinct(), "prefix-tokens")
    released(frame.sparkSession)
    heads = settled(tokens.groupBy("token").agg(
        F.min(F.struct("sid", "n", "at")).alias("head"), F.max("sid").alias("high"), F.count("*").alias("c")).where(
        "head.sid < high").select("token", F.col("head.sid").alias("low"), F.col("head.n").alias("nx"), F.col("head.at").alias("ax"), "c"), "shared-tokens")
    released(frame.sparkSession)
    lists = settled(tokens.join(heads, "token"), "posting-lists")
    dropped(tokens)
    dropped(heads)
    released(frame.sparkSession)

    def features(asked: DataFrame, *names: str) -> DataFrame:
        """(sid and the columns named) of the sets in ``asked`` and few others, once each."""
        held = sifted(sets.where("n > 0").select("sid", *names), asked.select("sid").distinct(), ["sid"])
        return held.groupBy("sid").agg(*[F.first(c).alias(c) for c in names])

    def kept(pairs: DataFrame, test: Column, *names: str) -> DataFrame:
        """Pairs (x, y) of sets that pass a test on the columns named, with the suffixes _x and _y."""
        asked = pairs.select(F.col("x").alias("sid")).unionByName(pairs.select(F.col("y").alias("sid")))
        side = settled(features(asked, *names), "features")
        released(frame.sparkSession)
        left, right = (side.toDF(c, *[f"{n}_{c}" for n in names]) for c in ("x", "y"))
        found = settled(pairs.join(left, "x").join(right, "y").where(test).select("x", "y"), "pairs")
        for table in (pairs, side):
            dropped(table)
        released(frame.sparkSession)
        return found

    def close(bits: str) -> Column:
        apart = F.aggregate(F.zip_with(f"{bits}_x", f"{bits}_y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
        return apart * (100 + percent) <= (F.col("n_x") + F.col("n_y")) * (100 - percent)

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs (x, y) of sets that have near bitmaps and share prefix tokens under the other orders."""
        return ordered_alike(kept(settled(pairs, "met"), close("bits"), "n", "bits"))

    def ordered_alike(pairs: DataFrame) -> DataFrame:
        orders = F.arrays_overlap("second_x", "second_y") & F.arrays_overlap("third_x", "third_y")
        return kept(pairs, orders, "second", "third")

    def fit(n1: str, at1: str, n2: str, at2: str) -> Column:
        a, b, c, d = (F.col(c) for c in (n1, at1, n2, at2))
        return long_enough(a, c, percent) & room(a, b, c, d, percent)

    def ordered() -> list[Column]:
        return [F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")]

    met = lists.where("sid <> low").where(fit("nx", "ax", "n", "at"))
    tried = near(met.select(F.col("low").alias("x"), F.col("sid").alias("y")).distinct())
    links = verified(tried, nodes, frame, size, percent)
    released(frame.sparkSession)
    # The pair of a list of two has met.
    rest, turn = lists.where("c > 2").select("token", "sid", "n", "at"), 0
    while True:
        roots = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
        group = settled(nodes.select("sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select(
            "sid", F.coalesce("root", "sid").alias("root")), "groups")
        # Only lists that still hold several groups go on, and of those only the ones with a pair
        # that has not met: all have met the smallest set, and then one that is not the smallest.
        placed = rest.join(group, "sid")
        several = settled(placed.groupBy("token").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.min("sid").alias("least"), F.count("*").alias("c")).where(
            (F.col("low") < F.col("high")) & (F.col("c") > min(turn, 1) + 2)).select("token", "least"), "open-tokens")
        opened = settled(placed.join(several, "token"), "open-lists")
        dropped(rest)
        rest, turn = opened.select("token", "sid", "n", "at"), turn + 1
        released(frame.sparkSession)
        if turn > ROUNDS:
            break
        # Another set of each list is met by those outside its group.
        hub = opened.where("sid <> least").groupBy("token").agg(F.min_by(
            F.struct("sid", "n", "at", "root"), F.xxhash64("token", "sid", F.lit(turn))).alias("hub"))
        hub = hub.select("token", F.col("hub.sid").alias("x"), F.col("hub.n").alias("nx"), F.col("hub.at").alias("ax"), F.col("hub.root").alias("rx"))
        met = opened.join(hub, "token").where((F.col("root") != F.col("rx")) & fit("nx", "ax", "n", "at"))
        met = met.withColumnRenamed("sid", "y").select(*ordered()).distinct()
        fresh = near(met.join(tried, ["x", "y"], "left_anti"))
        more = verified(fresh, nodes, frame, size, percent)
        tried, links = settled([tried, fresh], "tried"), settled([links, more], "links")

    # Every pair across groups that the lists still hold.
    main = settled(opened.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(
        F.max(F.struct("c", "root")).root.alias("main")), "main-groups")
    opened = opened.join(main, "token").join(features(opened, "bits"), "sid")
    names = ["n", "at", "root", "bits"]
    other = opened.where("root <> main").select("token", F.col("sid").alias("x"), *[F.col(c).alias(f"{c}_x") for c in names])
    mate = opened.select("token", F.col("sid").alias("y"), *[F.col(c).alias(f"{c}_y") for c in names], "main")
    across = other.join(
        mate, (other.token == mate.token) & F.expr("root_x <> root_y AND (root_y = main OR root_x < root_y)")
        & fit("n_x", "at_x", "n_y", "at_y") & close("bits"))
    last = ordered_alike(settled(across.select(*ordered()).distinct().join(tried, ["x", "y"], "left_anti"), "met"))
    dropped(rest)
    links = settled([links, verified(last, nodes, frame, size, percent)], "links")
    released(frame.sparkSession)
    roots = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))

    rooted = settled(nodes.select("sid", "at", "copies").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select(
        "sid", "at", "copies", F.coalesce("root", "sid").alias("root")), "groups")
    stays = settled(rooted.groupBy("root").agg(F.min("at").alias("stay"), F.sum("copies").alias("c")).where("c > 1").drop("c"), "stays")
    members = settled(rooted.join(stays, "root").select("sid", "stay"), "members")
    dropped(nodes)
    return sets.select("key", "tag", "n", "sid"), members


def similar_groups(docs: DataFrame, size: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_shingles and component_id, the smallest key reachable by links.

    Links join documents whose shingle sets have 100 * intersection >= percent * union. Null,
    empty and blank texts have no shingles, no links, and stand alone; equal texts are always
    linked; rows that share a key each get a row; an empty table gives no rows. Keys are integers.
    A document without key links others like any; component_id is null only where no document
    of the group has a key. Other columns are ignored.
    """
    sets, members = groups(docs, size, percent, key, text)
    return sets.join(members, "sid", "left").select(
        F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("stay.key", "key")).otherwise(F.col("key")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns, of each group one: that with the smallest key, one
    without a key only where the group has none with one; of rows that share key and text any.

    Documents without words are in no group and all stay, as do all columns whatever their names;
    of rows that share the key, but not the text, the one whose text has the smaller digest stays.
    """
    sets, members = groups(docs, size, percent, key, text)
    stays = F.col("key").eqNullSafe(F.col("stay.key")) & (F.col("tag") == F.col("stay.tag"))
    seen = sets.where("n > 0").join(members, "sid").groupBy("key", "tag").agg(
        F.bool_or(stays).alias("stays"), F.count("*").alias("c")).where("c > 1 OR NOT stays")
    seen = settled(seen.select(F.col("key").alias("_k"), F.col("tag").alias("_t"), "stays"), "decisions")
    dropped(sets)
    dropped(members)
    released(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.xxhash64(text).alias("_tag"), F.struct("*").alias("_row"))
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_tag") == F.col("_t"))
    once = rows.join(seen.where("stays"), same).groupBy("_key", "_tag").agg(F.first("_row").alias("_row"))
    return rows.join(seen, same, "left_anti").select("_row.*").unionByName(once.select("_row.*"))
