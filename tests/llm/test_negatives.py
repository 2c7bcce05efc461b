import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.llm import negatives

# Extra columns carry names that the operator uses inside.
SCHEMA = "vec_id long, embedding array<float>, label int, row int, score double, id string, weights int"


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5, "x", 2) for r in rows], SCHEMA)


def brute(rows, k=5, share=80, scale=256, every=10):
    held = []
    for key, vector, label in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            held.append((key, [math.floor(scale * x) for x in np.float32(vector).tolist()], label))
    last = float("inf")
    out = []
    for a, (key, v, label) in enumerate(held):
        if key is None or key % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), last if other is None else other, kind, n)
                        for n, (other, w, kind) in enumerate(held) if n != a)
        for p, pid, _, _ in [s for s in scored if s[2] == label][:k]:
            band = [s for s in scored if s[2] != label and share * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(key, None if pid == last else pid, n, None if s[1] == last else s[1], -p, -s[0]) for n, s in enumerate(band, 1)]
    return sorted(out, key=str)


def odd_rows(seed, n=150, width=6, labels=3):
    random.seed(seed)
    centre = {c: [random.gauss(0, 1) for _ in range(width)] for c in range(labels)}
    rows = []
    for i in range(n):
        c = random.randrange(labels)
        rows.append((i, [random.gauss(x, 0.7) for x in centre[c]][:random.choice([width, width, width - 1])], c))
    rows += [(200, None, 1), (201, [1.0, None], 1), (202, [float("nan")], 1), (203, [float("-inf")], 0), (204, [1.0], None),
             (205, [], 1), (210, [], 1), (220, [0.0] * width, 2)]
    rows += [(20, rows[20][1], rows[20][2]), (20, rows[30][1], rows[30][2]), (300, rows[40][1], rows[40][2]),
             (301, rows[40][1], rows[40][2]), (302, rows[40][1], (rows[40][2] + 1) % labels)]
    return rows + [(None, rows[50][1], rows[50][2])] * 7 + [(None, rows[60][1], (rows[60][2] + 1) % labels)] * 3


@pytest.mark.parametrize("settings", [{}, {"block": 16, "members": 3, "clusters": 4, "batch_bytes": 0}])
def test_against_brute_force(spark, settings):
    rows = odd_rows(5)
    got = negatives.hard_negatives(frame_of(spark, rows).repartition(3), F.col("id") % 10 == 0, **settings)
    want = brute(rows)
    assert want and sorted((tuple(r) for r in got.collect()), key=str) == want


def test_new_labels(spark):
    rows = odd_rows(6)
    relabelled = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    got = negatives.hard_negatives(frame_of(spark, rows), F.col("id") % 10 == 0, relabelled=relabelled)
    changed = [(i, v, (c + 1) % 3 if i is not None and c is not None and i % 7 == 0 else c) for i, v, c in rows]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(changed)


def test_walks_end_early_and_miss_nothing():
    random.seed(1)
    rng = np.random.default_rng(3)
    centre = np.eye(16)[rng.integers(0, 8, 4000)] * 200
    rows = np.floor(centre + rng.normal(0, 20, centre.shape)).astype(np.int64)
    members = rows[(centre[:, 0] > 0)][:20]
    walk = negatives.Walk(members, rows)
    for member, reach in zip(members, walk.reach):
        scores = rows @ member
        assert (scores[walk.order] <= reach * walk.bound).all()
        fifth = np.sort(scores)[-5]
        walked = next((high for low, high, most in walk.steps() if most[0] < fifth), len(rows))
        assert walked < len(rows) / 2


def test_large_weights_stay_exact():
    left, right = np.array([[3_000_000_019, 1]]), np.array([[3_000_000_037, 1], [3_000_000_037, 2]])
    assert negatives.products(left, right).tolist() == [[3_000_000_019 * 3_000_000_037 + 1, 3_000_000_019 * 3_000_000_037 + 2]]


def test_few_or_no_rows(spark):
    none = frame_of(spark, [(1, [1.0], 0)]).limit(0)
    assert negatives.hard_negatives(none, F.col("id") % 10 == 0).count() == 0
    alone = frame_of(spark, [(0, [1.0], 0), (5, [1.0], 1)])
    assert negatives.hard_negatives(alone, F.col("id") % 10 == 0).count() == 0
    few = frame_of(spark, [(0, [1.0], 0), (5, [1.0], 1), (6, [1.0], 0), (7, [0.5], 1)])
    assert [tuple(r) for r in negatives.hard_negatives(few, F.col("id") % 10 == 0).collect()] == [(0, 6, 1, 5, 65536, 65536)]


def test_very_long_vectors(spark):
    random.seed(2)
    rows = [(i, [random.uniform(-1, 1) for _ in range(20000)], i % 2) for i in range(12)]
    got = negatives.hard_negatives(frame_of(spark, rows), F.col("id") % 10 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
