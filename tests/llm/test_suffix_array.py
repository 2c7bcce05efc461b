import random
from collections import Counter

import numpy as np
import pytest

from weekloom.llm import suffix_array


def test_suffixes_are_sorted_and_repeats_found():
    random.seed(3)
    for _ in range(150):
        letters = random.choice([b"ab", b"abc\0", bytes(range(250, 256)), b"a"])
        pieces = [bytes(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(random.randint(1, 6))]
        order, raw, end_of = suffix_array.suffix_array(pieces, 20)
        whole = b"\0".join(pieces) + b"\0"
        suffixes = [whole[i:min(i + 20, end_of[i])] for i in order]
        assert suffixes == sorted(suffixes) and len(order) == sum(map(len, pieces))
        n = random.choice([8, 9, 12, 15])
        count = Counter(p[i:i + n] for p in pieces for i in range(len(p) - n + 1))
        want = [[i for i in range(len(p) - n + 1) if count[p[i:i + n]] > 1] for p in pieces]
        assert [g.tolist() for g in suffix_array.repeated_starts(pieces, n)] == want


def test_sliding_least_and_grams():
    values = np.random.default_rng(1).integers(0, 1000, 500).astype(np.uint64)
    for width in (1, 7, 369, 500):
        assert (suffix_array.sliding_least(values, width) == [values[i:i + width].min() for i in range(501 - width)]).all()
    data = np.tile(np.random.default_rng(2).integers(0, 9, 300).astype(np.uint8), 2)
    hashes = suffix_array.gram_hashes(data, 37)
    assert (hashes[:264] == hashes[300:564]).all() and len(set(hashes[:264].tolist())) == 264


def brute(texts, n):
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[i:i + n] for t in raw for i in range(len(t) - n + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i:i + n]] > 1:
                gone[i:i + n] = b"\1" * n
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("many", [64, 1])
def test_repeats_against_brute_force(monkeypatch, documents, many):
    monkeypatch.setattr(suffix_array, "MANY", many)
    monkeypatch.setattr(suffix_array, "PER_TASK", 2)
    random.seed(many)
    noise = lambda n: "".join(random.choice("abcdefgh é") for _ in range(n))
    passage, line = noise(130), noise(30)
    texts = [noise(random.randint(0, 90)) + passage[:random.randint(20, 130)] + noise(random.randint(0, 90)) for _ in range(25)]
    texts += [noise(200)] * 3 + ["ab" * 100, "a" * 150, (line + "\n") * 6, None, "", "short", passage[10:90], texts[0][5:]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
           for r in suffix_array.without_repeats(documents(texts), 40).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 40)


def test_equal_rows_and_empty_tables(documents):
    docs = documents(["x" * 5 + "abcdefghij" * 5, "nothing here to repeat at all"] * 2, ids=[1, 2, 1, 3])
    got = sorted((r.doc_id, r.n_removed) for r in suffix_array.without_repeats(docs, 20).collect())
    assert got == [(1, 55), (1, 55), (2, 29), (3, 29)]
    assert suffix_array.without_repeats(docs.limit(0), 20).count() == 0


def test_rows_without_ids_and_a_very_long_text(documents):
    random.seed(9)
    noise = lambda n: "".join(random.choices("abcdefgh é", k=n))
    passage = noise(60)
    texts = [noise(50) + passage + noise(i) for i in range(9)] + [noise(3_000_000) + "#" + passage + "#" + noise(40), passage, passage, None]
    ids = [None if i % 3 else 1 for i in range(9)] + [2, None, None, None]
    got = suffix_array.without_repeats(documents(texts, ids), 40).collect()
    sizes = lambda rows: sorted((r[0] or 0, *r[1:]) for r in rows)
    want = [(i, n, gone, spans) for i, (n, gone, spans, _) in zip(ids[:9] + ids[10:], brute(texts[:9] + texts[10:], 40), strict=True)]
    assert sizes((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got if r.doc_id != 2) == sizes(want)
    assert next(r.n_removed for r in got if r.doc_id == 2) == len(passage.encode())
