"""The pipeline on a small corpus with one case for each stage."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

from .conftest import SCHEMA, frame, words
from .test_operators import labelled, near_copies


def test_pipeline(spark, tmp_path):
    docs, labels = labelled(spark)
    rng = random.Random(31)
    base, item = words(rng, 120, 9000), words(rng, 40, 9000)
    extra = [(2000, base, "t"), (2001, near_copies(rng, base, 1, 1)[0], "t"), (2002, f"{words(rng, 60, 9000)} {item} x", "t"), (2003, f"{words(rng, 60, 9000)} token = abcdefgh12", None), (2004, None, "t")]
    extra.append(extra[3])
    columns = [c.split()[0] for c in SCHEMA.split(", ")][:5]
    long = f"{words(rng, 40_000, 9000)} token = abcdefgh12"
    extra.append((2005, long, "t"))
    whole = docs.unionByName(frame(spark, extra)).select(*columns).withColumn("ROW_NO", F.col("doc_id") + 7).withColumn("Size", F.lit("large")).withColumn("m_no", F.lit(1))
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    labels.drop("text").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.columns == [*whole.columns, "size_", "source_size", "target", "copies", "taken"]
    rows = result.collect()
    got = {r["doc_id"] for r in rows}
    assert got & {2000, 2001, 2002, 2003, 2004, 2005} == {2000, 2003, 2004, 2005}
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert texts[2000] == base and texts[2004] is None and texts[2003].endswith("<secret>") and texts[2005] == long.replace("token = abcdefgh12", "<secret>")
    assert all(r["ROW_NO"] == r["doc_id"] + 7 and r["Size"] == "large" and r["m_no"] == 1 for r in rows)
    assert all(r["taken"] == r["copies"] * len((r["text"] or "").split()) for r in rows)
    toxic = {i for i in range(600) if i % 5 == 0}
    assert len(got & toxic) <= 3 and len(set(range(600)) - toxic - got) <= 3
    kept = corpus_pipeline.hide_secrets(spark, spark.read.parquet(f"{tmp_path}/documents.parquet").filter("doc_id = 2003"), "")
    assert {r["text"].split()[-1] for r in kept.collect()} == {"<secret>"}


def test_pipeline_keeps_texts_that_share_an_id(spark, tmp_path):
    rng = random.Random(32)
    texts = [words(rng, 90, 9000) for _ in range(6)]
    rows = [(1, texts[0], "t"), (1, texts[1], "t"), (2, texts[2], "t"), (3, texts[2], "t"), (4, texts[1], "t"), (None, texts[3], "t"), (None, texts[3], "t"), (None, texts[4], "t"), (None, texts[0], "t"), (5, None, "t")]
    got = corpus_pipeline.one_of_each_group(spark, frame(spark, rows), "")
    assert got.columns == frame(spark, rows).columns
    assert sorted((r["doc_id"] or 0, texts.index(r["text"]) if r["text"] else -1) for r in got.collect()) == [(0, 3), (0, 4), (1, 0), (1, 1), (2, 2), (5, -1)]


def test_pipeline_on_an_empty_table(spark, tmp_path):
    columns = [c.split()[0] for c in SCHEMA.split(", ")][:5]
    frame(spark, []).select(*columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
