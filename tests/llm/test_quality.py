import random

import pytest
from pyspark.sql import functions as F

from weekloom.llm import quality

GOOD = "the of and in reading water garden morning letter quiet river window".split()
BAD = "BUY!! NOW!! $$$ ### CHEAP!! WIN!! *** CLICK!!".split()


@pytest.fixture
def labelled(spark, documents):
    random.seed(5)
    texts, labels = [], []
    for i in range(240):
        words = BAD if i % 4 == 0 else GOOD
        texts.append(" ".join(random.choice(words) for _ in range(random.randint(5, 60))))
        labels.append((i, 0 if i % 4 == 0 else 1, None))
    return documents(texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark, labelled):
    docs, labels = labelled
    got = quality.quality_scores(docs, labels, epochs=4).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 20
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_held_out_labels_are_not_learned_from(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda r: (r.doc_id, r.score)
    one, two = (sorted(map(key, quality.quality_scores(docs, x, epochs=1).collect())) for x in (labels, flipped))
    assert one == two


def test_odd_rows(spark, documents, labelled):
    docs, labels = labelled
    model = quality.train(docs, labels, epochs=2)
    odd = documents([None, "", " \n", "the river " * 50_000, "the", "the"], ids=[0, 1, 2, 3, 4, 4])
    got = quality.score(odd, model).collect()
    assert len(got) == 6 and len({r.score for r in got if r.doc_id in (0, 1)}) == 1
    kept = quality.accepted(odd, model)
    assert kept.columns == odd.columns and "the" in [r.text for r in kept.collect()]
    assert quality.accepted(odd.limit(0), model).count() == 0
    none = quality.quality_scores(odd, labels.limit(0)).collect()
    assert {r.score for r in none} != set() and all(0 <= r.score <= 1 for r in none)
    assert quality.quality_scores(odd.limit(0), labels.limit(0)).count() == 0


def test_folded_model_is_the_softmax(labelled):
    import numpy as np
    import pyarrow as pa

    from weekloom.llm.words import blocks

    docs, labels = labelled
    model = quality.train(docs, labels, epochs=1)
    (_, texts), = blocks(iter([pa.record_batch({"text": ["the water BUY!!", "a"]})]))
    found, first = quality.features(texts)
    folded = quality.probabilities(texts, *model.folded())
    for i in range(2):
        logits = model.vectors[found[first[i]:first[i + 1]]].mean(axis=0) @ model.layer + model.bias
        odds = np.exp(logits - logits.max())
        assert folded[i] == pytest.approx(odds[1] / odds.sum(), rel=1e-4)
