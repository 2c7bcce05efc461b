import zlib

from pyspark.sql import functions as F

from weekloom.llm import sharding


def test_neighbours_on_the_curve_touch(spark):
    cells = spark.range(512).select(*[(F.floor(F.col("id") / 8 ** k) % 8).cast("int").alias(c) for k, c in enumerate("xyz")])
    got = sorted(tuple(r) for r in cells.select(sharding.hilbert_index([F.col(c) for c in "xyz"], 3), "x", "y", "z").collect())
    assert [r[0] for r in got] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:])) == 1 for p, q in zip(got, got[1:]))


def test_shards_are_even_gapless_and_keep_equal_texts_together(spark, documents):
    texts = [f"text {i % 30} " + "word " * (i % 30) for i in range(200)] + [None, "", "é"]
    docs = documents(texts).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 7)).withColumn(
        "lang", F.when(F.col("doc_id") % 5 > 0, "en"))
    got = sharding.hilbert_shards(docs, 16).orderBy("shard", "slot").collect()
    sizes = [[r.slot for r in got if r.shard == s] for s in range(16)]
    assert all(s == list(range(len(s))) for s in sizes)
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1 and sum(map(len, sizes)) == 203
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    changes = sum((texts[a.doc_id] or "") != (texts[b.doc_id] or "") for a, b in zip(got, got[1:]))
    assert changes == len({t or "" for t in texts}) - 1


def test_repeated_rows_and_empty_tables(documents):
    docs = documents(["a", "a", "b"], ids=[1, 1, 2])
    assert sorted((r.shard, r.slot) for r in sharding.hilbert_shards(docs, 2).collect()) == [(0, 0), (0, 1), (1, 0)]
    assert sharding.hilbert_shards(docs.limit(0)).count() == 0


def test_written_shards(spark, documents, tmp_path):
    docs = documents(["a b", "c", "d e f", "g"]).withColumn("shard", F.lit("own"))
    sharding.write_shards(docs, sharding.hilbert_shards(docs, 2), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.groupBy("shard").count().count() == 2 and back.select("document.*").columns == docs.columns
