import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weekloom.session import settled


@pytest.fixture
def folder(spark, tmp_path):
    """Tables with clean, bad, copied and leaked documents, nulls, empty texts and columns to spare."""
    random.seed(8)
    words = [a + b for a in "ka lo mi su ve".split() for b in "na ri to pe du".split()]
    clean = [" ".join(random.choice(words) for _ in range(80)) for _ in range(60)]
    leak = " ".join(random.choice(words) for _ in range(30))
    near = clean[0].split()
    near[40] = "other"
    texts = [*clean, clean[1], " ".join(near), clean[2] + " " + leak, *[" ".join(["BUY!!", "NOW!!", "$$$"] * 20)] * 12, None, "", "été"]
    rows = [(i, t, random.choice(["en", None]), f"s{i % 4}", 0, 1.0, i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, key long").write.parquet(
        str(tmp_path / "documents.parquet"))
    labels = [(i, 0 if 63 <= i < 75 else 1, 0) for i in range(75) if i % 2 == 0 or i >= 63]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixture", "shards"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = settled(stage(spark, docs, folder), name)
        assert out.columns == docs.columns
        kept[name], docs = {r.doc_id for r in out.collect()}, out
    assert not kept["quality"] & set(range(63, 75)) and set(range(63)) <= kept["quality"]
    assert kept["quality"] - kept["near_duplicates"] == {60, 61}
    assert kept["near_duplicates"] - kept["decontamination"] == {62}
    assert kept["mixture"] <= kept["decontamination"]
    final = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert final.count() == docs.count()


def test_run_on_empty_documents(spark, folder, tmp_path):
    import shutil
    other = tmp_path / "empty"
    other.mkdir()
    spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False)).write.parquet(str(other / "documents.parquet"))
    for name in ("labels", "benchmark"):
        shutil.copytree(f"{folder}/{name}.parquet", other / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(other)).count() == 0
