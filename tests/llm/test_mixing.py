from collections import defaultdict

from pyspark.sql import functions as F

from weekloom.llm import mixing


def corpus(spark, leaves):
    """Documents of ten tokens: leaves maps (lang, source) to their number."""
    rows, n = [], 0
    for (lang, source), count in leaves.items():
        for _ in range(count):
            rows.append((n, "one two three four five six seven eight nine ten", lang, source, 0, "x"))
            n += 1
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, times int, budget string")


def totals(chosen):
    out = defaultdict(int)
    for r in chosen.collect():
        out[r.domain, r.lang, r.source] += r.n_tokens
    return dict(out)


def domain():
    return F.when(F.col("source").startswith("a"), "A").otherwise("B")


def test_weights_are_met(spark):
    docs = corpus(spark, {("x", "a1"): 40, ("x", "b1"): 40})
    chosen = mixing.mixture(docs, {"domain": F.when(F.col("domain") == "A", 3).otherwise(1)}, share=0.5, max_epochs=1, domain=domain())
    assert totals(chosen) == {("A", "x", "a1"): 300, ("B", "x", "b1"): 100}


def test_siblings_take_a_shortage_before_other_branches(spark):
    docs = corpus(spark, {("x", "a1"): 2, ("x", "a2"): 40, ("y", "a3"): 40, ("x", "b1"): 40})
    chosen = mixing.mixture(docs, {}, share=400 / 1220, max_epochs=1, domain=domain())
    # A gets 200, its languages 100 each; a1 holds 20, so a2 takes 80.
    assert totals(chosen) == {("A", "x", "a1"): 20, ("A", "x", "a2"): 80, ("A", "y", "a3"): 100, ("B", "x", "b1"): 200}


def test_epochs_repeat_documents_and_each_epoch_once(spark):
    docs = corpus(spark, {("x", "a1"): 5, ("x", "b1"): 50})
    chosen = mixing.mixture(docs, {}, share=0.2, max_epochs=3, domain=domain()).cache()
    assert totals(chosen) == {("A", "x", "a1"): 60, ("B", "x", "b1"): 60}
    assert chosen.count() == chosen.select("doc_id", "epoch").distinct().count() == 12
    full = mixing.mixed_documents(docs, chosen)
    assert full.columns == docs.columns and full.count() == 12
    assert chosen.where("domain = 'A' and epoch = 0").count() == 5


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "x", "a"), (3, "one two", "x", "a"), (3, "one two", "x", "a"), (4, " \t three ", None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mixture(docs, {}, max_epochs=1).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got if r.n_tokens) == [(3, 2), (4, 1)]
    assert mixing.mixture(docs.limit(0), {}).count() == 0


def test_documents_without_ids_and_repeated_rows_stay(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 3)
    long = "word " * 1_000_000
    rows = [(None, "a b", "x", "s", 1), (None, "a b", "x", "s", 2), (None, "c d", "x", "s", 3), (7, "e f", None, "s", 4),
            (7, "e f", None, "s", 5), (7, "g", None, "s", 6), (None, None, "x", None, 7), (8, long, "x", "s", 8),
            *[(None, "copy", "x", "s", 9)] * 10]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, times int")
    whole = mixing.mixture(docs, {}, max_epochs=1)
    assert sum(r.n_tokens * r.copies for r in whole.collect()) == 1_000_000 + 2 * 3 + 2 * 2 + 1 + 10
    out = mixing.mixed_documents(docs, whole)
    assert out.columns == docs.columns
    # Texts without tokens are never needed; every other row comes once.
    assert sorted((str(r.doc_id), r.text) for r in out.collect() if r.text) == sorted((str(r[0]), r[1]) for r in rows if r[1])


def test_part_of_equal_rows(spark):
    docs = spark.createDataFrame([(None, "one two", "x", "s")] * 10, "doc_id long, text string, lang string, source string")
    chosen = mixing.mixture(docs, {}, share=1.35, max_epochs=2)
    assert sorted((r.epoch, r.copies) for r in chosen.collect()) == [(0, 10), (1, 4)]
    assert mixing.mixed_documents(docs, chosen).count() == 14
