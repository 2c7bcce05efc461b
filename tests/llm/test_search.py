import math
import random

import pytest
from pyspark.sql import functions as F

from weekloom.llm import search


@pytest.mark.parametrize("block, batch_bytes", [(2048, 1 << 24), (7, 100)])
def test_top_k_against_brute_force(spark, block, batch_bytes):
    random.seed(block)
    rows = [(i, [random.choice([0.0, 0.0, random.uniform(-2, 2)]) for _ in range(random.choice([5, 6]))], 0) for i in range(60)]
    rows += [(60, None, 1), (61, [1.0, None], 1), (62, [float("nan")], 1), (63, [float("inf")], 1), (64, [], 1), (70, rows[3][1], 2),
             (71, rows[3][1], 2), (5, rows[5][1], 9), (10, [2.0, 1.0], 0), (10, [3.0], 0), (20, rows[20][1], 0)]
    rows += [(None, rows[7][1], 0)] * 40
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = search.top_k(frame.repartition(3), F.col("id") % 10 == 0, k=4, block=block, batch_bytes=batch_bytes).collect()
    held = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in frame.collect()
            if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    want = []
    for n, (q, weights) in enumerate(held):
        if q is not None and q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(weights, other)), c is None, c or 0)
                            for m, (c, other) in enumerate(held) if m != n)[:4]
            want += [(q, rank, None if none else c, -s) for rank, (s, none, c) in enumerate(scored, 1)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_few_or_no_rows(spark):
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert search.top_k(one, F.col("id") % 10 == 0).count() == 0
    assert search.top_k(one.limit(0), F.col("id") % 10 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (3, [-1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in search.top_k(two, F.col("id") % 10 == 0).collect()] == [(0, 1, 3, -1048576)]
    same = spark.createDataFrame([(0, [2.0]), (1, [2.0]), (1, [3.0])], "vec_id long, embedding array<float>")
    assert [r.score >> 20 for r in search.top_k(same, F.col("id") == 0).orderBy("rank").collect()] == [6, 4]
