import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.llm import jaccard
from weekloom.llm.components import components
from weekloom.llm.words import Texts
from weekloom.session import shared_folder


def shingles(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(len(words) - size + 1, 1))}


def brute(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1:]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize("size, percent, members", [(4, 85, 512), (2, 60, 3)])
def test_groups_against_brute_force(monkeypatch, documents, size, percent, members):
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    random.seed(size)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(12):
        base = [random.choice(vocabulary) for _ in range(random.randint(1, 90))]
        for _ in range(random.randint(1, 6)):
            copy = list(base)
            for _ in range(random.randint(0, 3)):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [None, "", "\n\t", "W1 w2", "w1  W2", "w1 w2 w3", texts[0].upper(), "w5"]
    got = sorted(tuple(r) for r in jaccard.similar_groups(documents(texts), size, percent).collect())
    assert got == brute(list(enumerate(texts)), size, percent)


def test_one_of_each_keeps_columns_and_lone_texts(documents):
    docs = documents(["a b c d e f", "a b c d e f", "A b c d e f", None, None, "", "x"], ids=[5, 3, 9, 1, 1, 2, 7])
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 2, 3, 7]
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 90, 90: 90, 95: 90}


def test_documents_without_ids_link_like_others(documents):
    a = "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9"
    b, c = a + " x1", "other words stand here in a row of ten words now"
    docs = documents([a, b, a, c, c, None, "", c.replace("now", "then"), a], ids=[None, 5, 9, None, None, None, None, 8, 5])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, 4, 85).collect()), key=str)
    none = [(None, n, c) for n, c in ((32, 5), (8, None), (8, None), (0, None), (0, None))]
    assert got == sorted([*none, (5, 33, 5), (9, 32, 5), (8, 8, 8), (5, 32, 5)], key=str)
    kept = jaccard.one_of_each(docs, 4, 85)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(rows, key=str) == sorted([next(r for r in rows if r[0] == 5), (None, c), (8, c.replace("now", "then")), (None, None), (None, "")], key=str)


def test_a_third_without_ids_and_one_very_long_text(documents):
    random.seed(4)
    texts = [" ".join(random.choice("abcdefgh") for _ in range(12)) for _ in range(60)]
    long = " ".join(f"w{random.randrange(10 ** 6)}" for _ in range(400_000))
    texts += [long, long + " end"]
    ids = [None if i % 3 == 0 else i for i in range(len(texts))]
    docs = documents(texts, ids=ids)
    got = jaccard.similar_groups(docs, 4, 85).collect()
    assert len(got) == len(texts)
    # Both long texts are one group, and the one with an id names it.
    assert {r.component_id for r in got if r.n_shingles > 100_000} == {61}
    assert jaccard.one_of_each(docs, 4, 85).count() == len(set(texts)) - 1


def test_many_middling_copies_of_one_text(documents):
    """Sets of one list that only link in chains through others than its smallest one."""
    random.seed(6)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(120):
        words = list(base)
        for at in random.sample(range(60), 2):
            words[at] = f"v{random.randrange(40)}"
        texts.append(" ".join(words))
    got = sorted(tuple(r) for r in jaccard.similar_groups(documents(texts), 4, 72).collect())
    assert got == brute(list(enumerate(texts)), 4, 72)


def test_only_texts_that_are_asked_for_move(spark, rows):
    """Keys and tags of any kind pass if asked for; nearly all others stay where they lie."""
    frame = spark.range(4000).select(
        F.when(F.col("id") % 7 > 0, F.col("id")).alias("key"), F.xxhash64("id").alias("tag"), F.col("id").cast("string").alias("text"))
    asked = frame.where("text % 41 = 0").select("key", "tag", F.lit(1).alias("sid"))
    passed = jaccard.sifted(frame, asked)
    assert passed.columns == frame.columns
    assert rows(frame.where("text % 41 = 0").exceptAll(passed)) == [] and passed.count() < 110
    assert jaccard.sifted(frame, asked.limit(0)).count() == 0


def test_tables_go_when_read(spark, documents):
    """Once the decisions are made nothing that grows with texts or posting lists is kept."""
    texts = [f"{'a b c d e f g h i j k l m n ' * 2}{i % 3} {i // 3}" for i in range(9)]
    before = set(os.listdir(shared_folder(spark)))
    kept = jaccard.one_of_each(documents(texts), 5, 60)
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(shared_folder(spark))) - before
            if any(f.endswith(".parquet") for f in os.listdir(f"{shared_folder(spark)}/{name}"))}
    assert kept.count() == 1
    assert "decisions" in left
    assert not left & {"sets", "nodes", "features", "prefix-tokens", "shared-tokens", "posting-lists", "open-lists", "asked-texts"}


def test_only_shared_prefix_tokens_become_rows(documents):
    """Prefix tokens that one document alone holds are no rows; those of several all are."""
    random.seed(8)
    texts = [" ".join(f"w{random.randrange(10 ** 6)}" for _ in range(200)) for _ in range(60)]
    texts += [texts[0] + " end", None, "", texts[1]]
    levels = np.zeros(1 << jaccard.SKETCH_BITS, dtype=np.uint8)
    rows = jaccard.prefixes(documents(texts), levels, 4, 85).collect()
    held = {r.token for r in rows}
    raw = [(t or "").encode() for t in texts]
    block = Texts(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    first = [set(tokens.view(np.int64).tolist()) for _, tokens in jaccard.prefix_tokens(block, levels, 4, 85)]
    count = Counter(t for tokens in first for t in tokens)
    assert {t for t, n in count.items() if n > 1} <= held
    assert len(rows) < 0.2 * sum(map(len, first))
    assert all(r.at < r.n for r in rows)
