from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from weftline.operators import metrics, tokens
from weftline.sources import readers, sinks
from weftline.streaming import incremental


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([([("user", "hé"), ("assistant", "b")], "chat"), ([], "none")], "messages array<struct<role:string,content:string>>, category string")
    path = str(tmp_path / "a.jsonl")
    sinks.jsonl(rows, path)
    (tmp_path / "a.jsonl" / "z.txt").write_text('\n   \n{"messages": [{"role"\nnot json\n')
    got = readers.jsonl_files(spark, [path]).collect()
    assert len(got) == 1 and got[0].messages[0].content == "hé" and got[0].category == "chat"
    assert readers.jsonl_files(spark, []).count() == 0


def test_token_files(spark, tmp_path):
    for dtype, values in (("uint16", [0, 1, 65535]), ("uint32", [7, 2**32 - 1])):
        f = tmp_path / f"{dtype}.bin"
        f.write_bytes(np.array(values, dtype).tobytes() + b"\x01")
        got = readers.token_files(spark, str(f), dtype).orderBy("pos").collect()
        assert [r.token for r in got] == values


def test_sidecar_and_reuse(spark, tmp_path):
    good, bad = tmp_path / "m.json", tmp_path / "b.json"
    good.write_text(json.dumps({"model_id": "m", "vocab": 5, "train_tokens": 10}))
    bad.write_text('{"model_id": ')
    schema = "model_id string, vocab long, train_tokens long"
    assert readers.sidecar(spark, str(good), schema).first().vocab == 5
    assert readers.sidecar(spark, str(bad), schema) is None
    assert readers.sidecar(spark, str(tmp_path / "none.json"), schema) is None
    assert readers.reusable(spark, str(good), {"model_id": "m", "train_tokens": 9}, schema)
    assert not readers.reusable(spark, str(good), {"model_id": "m", "train_tokens": 11}, schema)


def test_missing_source_is_left_out(spark, sf):
    got = readers.sources(spark, {"docs": f"{sf}/documents.parquet", "gone": f"{sf}/nothing.parquet"})
    assert list(got) == ["docs"]


def test_images_text_and_synthetic(spark, tmp_path):
    (tmp_path / "x.u8").write_bytes(bytes([0, 255, 51, 0]))
    rows = readers.images(spark, str(tmp_path / "x.u8"), 2).orderBy("id").collect()
    assert [[round(v, 3) for v in r.x] for r in rows] == [[0, 1], [0.2, 0]]
    (tmp_path / "t.txt").write_text("a\nb")
    assert readers.plain_text(spark, str(tmp_path / "t.txt")).first().text == "a\nb"
    for kind in ("bits", "xor", "template"):
        got = readers.synthetic(spark, kind, 200).collect()
        assert len({r.label for r in got}) >= 2
    bits = readers.synthetic(spark, "bits", 200).collect()
    assert all(r.label == (sum(r.x) > 5) for r in bits)
    parts = readers.frozen_split(spark.range(100), "id", 70).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"train": 70, "test": 30}


def test_scoreboard_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None, "broke"), (2, "b", 9.0, None), (3, "c", 3.0, None), (4, "d", None, "gone")], "seq int, model string, ppl double, error string")
    ranked = metrics.scoreboard(rows)
    assert [r.model for r in ranked.orderBy("place").collect()] == ["c", "b", "a", "d"]
    sinks.scoreboard(ranked, str(tmp_path / "s"), 17.19)
    got = json.loads(spark.read.text(str(tmp_path / "s")).first().value)
    assert got["reference"] == 17.19 and [r["model"] for r in got["results"]] == ["c", "b", "a", "d"]
    sinks.manifest(spark.createDataFrame([("m", 5)], "model_id string, vocab long"), str(tmp_path / "m"))
    assert readers.sidecar(spark, str(tmp_path / "m"), "model_id string, vocab long").first().vocab == 5


def test_eval_tokens_and_detokenized(spark, tmp_path):
    d = spark.createDataFrame([(0, "a b c"), (1, ""), (2, "d e")], "doc_id long, text string")
    s = tokens.stream(d)
    sinks.eval_tokens(s, str(tmp_path / "e"), 4)
    assert sum(r.n for r in spark.read.parquet(str(tmp_path / "e")).collect()) == 4
    assert sum(r.n for r in readers.test_split(s, 4).collect()) == 4
    vocab = spark.createDataFrame([(1, "x"), (2, "y")], "id int, word string")
    got = sinks.detokenized(spark.createDataFrame([(1, [2, 1, 9])], "k long, ids array<int>"), vocab).first()
    assert got.text == "y x <unk>"


def test_streaming_counts_match_batch(spark, sf, tmp_path):
    src = tmp_path / "in"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(5).write.parquet(str(src))
    seen = {}

    def sink(rows, number):
        seen.update({r.word: r.freq for r in rows.collect()})

    incremental.run_to_end(incremental.word_counts(incremental.documents(spark, str(src), 2)), sink, str(tmp_path / "cp"))
    batch = {r.word: r.freq for r in incremental.word_counts(docs).collect()}
    assert seen == batch and len(batch) > 100


def test_append_until_target(spark, tmp_path):
    sink = incremental.append_until(str(tmp_path / "out"), 25)
    for k in range(4):
        sink(spark.range(10).select(F.lit(1).alias("est")), k)
    sink(spark.range(10).select(F.lit(1).alias("est")), 1)  # a round that is run again
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
