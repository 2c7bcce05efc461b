import hashlib
import random
import re

import pytest

from weekloom.llm import decontamination


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items, n):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - n + 1, min(len(w), 1))):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for i, text in enumerate(texts):
        w, hit, found = words(text), set(), set()
        for window, owners in windows.items():
            for p in range(len(w) - len(window) + 1):
                if tuple(w[p:p + len(window)]) == window:
                    hit |= set(range(p, p + len(window)))
                    found |= owners
        listed = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_hits_against_brute_force(spark, documents, block):
    random.seed(1)
    pick = lambda n: " ".join(random.choice("alpha beta Gamma dél-ta 42 eps".split()) for _ in range(n))
    items = [(i, pick(random.randint(0, 25))) for i in range(20)] + [(30, None), (31, "Nur ein"), (32, "einzig"), (10, "again ten")]
    texts = [pick(random.randint(0, 40)) for _ in range(15)]
    texts += [items[k][1] + " tail" for k in range(6)] + [None, "", "...", "nur, EIN einzig", (items[4][1] + "\n") * 3]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")
    got = sorted(tuple(r) for r in decontamination.contamination(documents(texts), benchmark, 6, block_bytes=block).collect())
    assert got == brute(texts, items, 6)


def test_clean_keeps_rows_and_columns(spark, documents):
    docs = documents(["one two three four", "zero one two three nine", None, "", "one two"], ids=[1, 2, 3, 3, 5])
    benchmark = spark.createDataFrame([(7, "One, two three")], "item_id long, text string")
    kept = decontamination.clean(docs, benchmark, 3)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 3, 5]
    assert decontamination.clean(docs, benchmark.limit(0)).count() == 5
    assert decontamination.contamination(docs.limit(0), benchmark).count() == 0


def test_rows_and_items_without_id(spark, documents):
    """A third of all rows without id, and items without id, that are one item."""
    texts = ["one two three four", "zero one two three nine", "clean", "clean", "five six seven", "clean one"] * 5
    docs = documents(texts, ids=[None, 1, None, 1, 2, None] * 5)
    benchmark = spark.createDataFrame(
        [(None, "One, two three"), (None, "five six seven"), (None, None), (4, "two three four")], "item_id long, text string")
    got = sorted((tuple(r)[0:4] + (r.contaminated,) for r in decontamination.contamination(docs, benchmark, 3).collect()), key=str)
    want = [(None, 4, 4, 2, True), (1, 5, 3, 1, True), (None, 1, 0, 0, False), (1, 1, 0, 0, False), (2, 3, 3, 1, True), (None, 2, 0, 0, False)]
    assert got == sorted(want * 5, key=str)
    kept = decontamination.clean(docs, benchmark, 3).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, "clean"), (1, "clean"), (None, "clean one")] * 5, key=str)


def test_a_text_of_several_megabytes(spark, documents):
    long = "filler word " * 300_000
    docs = documents([long + "one two three " + long, long])
    benchmark = spark.createDataFrame([(7, "One, two three")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontamination.contamination(docs, benchmark, 3).collect()}
    assert got == {0: (1_200_003, 3), 1: (600_000, 0)}
