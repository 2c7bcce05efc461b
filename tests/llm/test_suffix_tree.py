import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.llm import suffix_tree


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


@pytest.fixture
def corpus(documents):
    random.seed(2)
    texts = [" ".join(random.choice("the of Die und maison été then there".split()) for _ in range(random.randint(0, 40))) for _ in range(60)]
    return documents([*texts, None, "", " \t ", "unseen zzz", "été"], ids=[*range(60), 60, 61, 62, 63, 63])


@pytest.mark.parametrize("block", [48 << 20, 400])
def test_counts_and_base_score(corpus, block):
    got = suffix_tree.suffix_tree_scores(corpus, F.col("doc_id") % 3 == 0, block_bytes=block).collect()
    rows = corpus.select("doc_id", "text").collect()
    count = Counter(t for r in rows if r.doc_id % 3 for t in tokens(r.text))
    n, v = sum(count.values()), len(count)
    want = sorted((r.doc_id, len(t), sum(count[x] > 0 for x in t), round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t), 6))
                  for r in rows for t in [tokens(r.text)])
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.held_out == (r.doc_id % 3 == 0) and r.score < 0 for r in got)


def test_the_tree_is_a_distribution_and_learns(corpus):
    got = suffix_tree.suffix_tree_scores(corpus, F.col("doc_id") % 3 == 0).collect()
    strange = next(r for r in got if r.doc_id == 63 and r.n_tokens == 3)
    usual = [r for r in got if r.held_out and r.n_tokens > 10]
    assert all(r.score / r.n_tokens > strange.score / strange.n_tokens for r in usual)
    counts = Counter()
    data = b"\n" * 5 + b"the then there the then\n" * 20
    for i in range(5, len(data)):
        for d in range(6):
            counts[d, int.from_bytes(data[i - d:i + 1], "big")] += 1
    tree = suffix_tree.Tree(*(np.array(x) for x in zip(*((d, c, n) for (d, c), n in counts.items()))))
    for context in (b"e the", b"\nthen", b"zzzzz", b"xxthe"):
        codes = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], dtype=np.uint64)
        assert (10 ** tree.scores(codes)).sum() == pytest.approx(1, rel=1e-9)
    likely = int.from_bytes(b"e the", "big")
    assert tree.scores(np.array([likely << 8 | ord("n")], dtype=np.uint64))[0] > math.log10(0.2)


def test_no_training_rows_and_no_rows(corpus):
    got = suffix_tree.suffix_tree_scores(corpus, F.lit(True)).collect()
    assert len(got) == 65 and {(r.n_known, r.train_tokens) for r in got} == {(0, 0)}
    empty = next(r for r in got if r.doc_id == 61)
    assert empty.score == pytest.approx(-math.log10(256)) and empty.base_score == 0
    assert suffix_tree.suffix_tree_scores(corpus.limit(0), F.lit(False)).count() == 0
