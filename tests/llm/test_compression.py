import hashlib
import math
import random

import numpy as np
import pytest

from weekloom.llm import compression

SCHEMA = "vec_id long, embedding array<float>, label int, id string, code int, error double, weights int"


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5, 2) for r in rows], SCHEMA)


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    held = [(key, [math.floor(scale * x) for x in np.float32(v).tolist()], label) for key, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    step = -(-max((len(v) for _, v, _ in held), default=0) // parts)
    first = sorted(held, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    held = [(key, v + [0] * (step * parts - len(v)), label) for key, v, label in held]
    cut = lambda v, p: v[p * step:(p + 1) * step]
    books = [[cut(v + [0] * (step * parts - len(v)), p) for _, v, _ in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            found = {}
            for _, v, _ in held:
                found.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [[sum(x) // len(found[n]) for x in zip(*found[n])] if n in found else e for n, e in enumerate(book)]
    out = []
    for key, v, label in held:
        best = [near(cut(v, p), book) for p, book in enumerate(books)]
        out.append((key, label, "".join(f"{n:02x}" for _, n in best), sum(d for d, _ in best)))
    numbers = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(out, key=str), hashlib.sha256(numbers.encode()).hexdigest()


@pytest.mark.parametrize("entries, block, partitions", [(256, 2048, 1), (16, 2048, 3), (7, 40, 2), (1, 10, 2)])
def test_against_brute_force(spark, entries, block, partitions):
    random.seed(entries)
    centre = [[random.gauss(0, 1) for _ in range(10)] for _ in range(9)]
    rows = [(i, [random.gauss(x, random.choice([0, 0.05, 0.5])) for x in random.choice(centre)][:random.choice([10, 10, 7])],
             random.choice([1, 2, None])) for i in range(220)]
    rows += [(300, None, 1), (301, [1.0, None], 1), (302, [float("nan")], 2), (303, [float("inf")], 2), (304, [], 7)]
    rows += [(3, rows[3][1], 1), (3, rows[4][1], 1), (None, rows[5][1], None)] + [(400 + i, rows[6][1], 3) for i in range(150)]
    coded, books = compression.compressed(frame_of(spark, rows).repartition(partitions), entries=entries, block=block)
    want, digest = brute(rows, entries=entries)
    assert sorted((tuple(r) for r in coded.collect()), key=str) == want
    assert books.digest() == digest


def test_label_errors_join_nulls(spark):
    rows = [(i, [float(i * i % 17), 1.0], [1, None, 2][i % 3]) for i in range(40)]
    coded, _ = compression.compressed(frame_of(spark, rows), entries=4)
    got = compression.with_label_error(coded).collect()
    sums = {}
    for r in got:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert len(got) == 40 and all(r.label_error == sums[r.label] for r in got)


def test_empty_tables_and_vectors(spark):
    coded, books = compression.compressed(frame_of(spark, [(1, [1.0], 0)]).limit(0))
    assert compression.with_label_error(coded).count() == 0 and books.digest() == hashlib.sha256(b"").hexdigest()
    coded, books = compression.compressed(frame_of(spark, [(1, [], 0), (2, [], 0)]))
    assert sorted(tuple(r) for r in coded.collect()) == [(1, 0, "00000000", 0), (2, 0, "00000000", 0)]
    with pytest.raises(ValueError):
        compression.compressed(coded, entries=257)


def test_bounds_assign_whole_nodes():
    """Parts that lie in tight groups are assigned by node, and as each part alone would be."""
    rng = np.random.default_rng(1)
    centre = rng.integers(-4000, 4000, (12, 8))
    points = np.sort(rng.integers(0, 12, 12000))
    parts = centre[points] + rng.integers(-3, 4, (12000, 8))
    finder, part = compression.Assigner(centre), compression.Part.of(parts)
    whole = sum(part.tree.last[node] - first for node, _, first, numbers in finder.walk(part) if numbers is None)
    assert whole > 6000
    number, apart = finder.numbers(part)
    distance = ((parts[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2)
    assert (number == distance.argmin(axis=1)).all() and (apart == distance.min(axis=1)).all()
    counts, totals = np.zeros(12, dtype=np.int64), np.zeros_like(centre)
    finder.add_sums(part, counts, totals)
    assert (counts == np.bincount(number, minlength=12)).all() and (totals.sum(axis=0) == parts.sum(axis=0)).all()


def test_distances_beyond_doubles():
    points, entries = np.array([[3_000_000_001, 5]]), np.array([[3, 5], [4, 5], [3, 4]])
    assert compression.squared_distances(points, entries).tolist() == [[2_999_999_998 ** 2, 2_999_999_997 ** 2, 2_999_999_998 ** 2 + 1]]
