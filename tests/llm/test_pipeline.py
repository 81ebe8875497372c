from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import bpe, jaccard, mixing, quality_cnn, secrets


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "secret_scans", "mixture", "encode"]
    at = docs
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.columns == docs.columns
        rows = at.collect()
        at = spark.createDataFrame(rows, docs.schema)
        sizes.append(len(rows))
    assert docs.count() > sizes[0] > sizes[1] == sizes[2] > sizes[3] > 0
    model = quality_cnn.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    by_hand = quality_cnn.kept(docs, model)
    by_hand = mixing.sampled(secrets.redacted(jaccard.one_of_each(by_hand)))
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.public_path("word_bpe_49k.json"))
    want = {r.doc_id: hashlib.sha256(" ".join(map(str, lib.encode(r.text, add_special_tokens=False).ids)).encode()).hexdigest() for r in by_hand.collect()}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def hostile(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = "a plain sentence of words that is long enough to be judged as what it is. " * 8
    rows = [(None, text, "en", "s", 5), (None, None, None, None, None), (900_001, None, "en", None, 0), (900_002, "", None, "s", 0), (900_003, " \n\t ", "xx", "s", 5)]
    rows += [(900_004, text + f"token = 'abcd{'efgh1234' * 3}'", "en", "s", 9)] * 3
    rows += [(900_005, "w%d " * 60_000 % tuple(range(60_000)), "en", "long", 1), (900_006, "é\U0001f600 " * 4000, "fr", "s", 1)]
    more = spark.createDataFrame(rows, docs.schema)
    return docs.unionByName(more).withColumns({"digest": F.lit("mine"), "row": F.lit(7), "ids": F.lit("x"), "key": F.col("doc_id"), "__text": F.lit(1)})


def test_stages_on_hostile_rows(spark, tmp_path):
    sf, own = "/root/testdata/sf0.001", str(tmp_path)
    hostile(spark, sf).repartition(3).write.parquet(f"{own}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{own}/labels.parquet")
    at, docs = spark.read.parquet(f"{own}/documents.parquet"), spark.read.parquet(f"{own}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, own)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{own}/{k}")
        before, at = at, spark.read.parquet(f"{own}/{k}")
        assert at.select("doc_id", "lang", "source").exceptAll(before.select("doc_id", "lang", "source")).count() == 0
        assert at.select("digest", "row", "ids", "__text").distinct().collect() == [("mine", 7, "x", 1)]
        if name == "near_duplicates":
            texts = [r.text for r in at.where("doc_id = 900004").collect()]
            assert len(texts) <= 1
        if name == "secret_scans":
            assert at.count() == before.count()
            assert not at.where(F.col("text").contains("efgh1234efgh1234")).where("doc_id = 900004").count()
    last = at.count()
    got = corpus_pipeline.encode(spark, at, own)
    assert got.count() == last and got.where("n_tokens = 0").count() >= at.where("text is null or trim(text) = ''").count()
    ran = corpus_pipeline.run(spark, own)
    assert sorted(r.ids_sha256 for r in ran.collect()) == sorted(r.ids_sha256 for r in got.collect())


def test_empty_tables_go_through(spark, tmp_path):
    sf, own = "/root/testdata/sf0.001", str(tmp_path)
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{own}/{name}.parquet")
    assert corpus_pipeline.run(spark, own).count() == 0
