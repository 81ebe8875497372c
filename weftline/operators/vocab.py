"""Vocabularies: frequencies, ranks, ids, classes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens

MOST = 4095
UNKNOWN = "<unk>"


def frequencies(s: DataFrame) -> DataFrame:
    return s.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def top(freqs: DataFrame, most: int = MOST) -> DataFrame:
    """id, word, freq of the most frequent words, ties by bytes; ids from 1, as 0 is the unknown word. At most `most` rows."""
    best = freqs.orderBy(F.desc("freq"), "word").limit(most)
    return best.withColumn("id", F.row_number().over(Window.orderBy(F.desc("freq"), "word"))).select("id", "word", "freq")


def mapped(s: DataFrame, vocab: DataFrame) -> DataFrame:
    """pos, doc_id, id of each token; 0 for unknown words. The vocabulary is bounded, so it is broadcast."""
    rows = tokens.positions(s)
    return rows.join(F.broadcast(vocab.select(F.col("word").alias("token"), "id")), "token", "left").select("pos", "doc_id", F.coalesce("id", F.lit(0)).alias("id"))


def mapped_stream(s: DataFrame, vocab: DataFrame) -> DataFrame:
    """The stream with ids for tokens, row by row: start, n, tokens, doc_id, and lead if the stream has it. The bounded vocabulary is sent to the tasks; nothing is shuffled."""
    own = vocab.select("id", "word").collect()  # at most MOST rows
    shared = s.sparkSession.sparkContext.broadcast(([r.word for r in own], [r.id for r in own]))
    arrays = [c for c in ("tokens", "lead") if c in s.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = pa.array(shared.value[0], pa.string()), pa.array([*shared.value[1], 0], pa.int32()).to_numpy()
        for batch in batches:
            cols = [batch.column(0), batch.column(1), batch.column(2)]
            for k in range(len(arrays)):
                x = batch.column(3 + k)
                at = pc.fill_null(pc.index_in(x.flatten(), words), len(words)).to_numpy()  # the last id is that of the unknown word
                offsets = x.offsets.to_numpy() - x.offsets[0].as_py()
                cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[at])))
            yield pa.RecordBatch.from_arrays(cols, names=["start", "n", "doc_id", *arrays])

    rows = s.where("n > 0").select("start", "n", "doc_id", *arrays)
    return rows.mapInArrow(run, "start long, n long, doc_id long, " + ", ".join(f"{c} array<int>" for c in arrays))


def classes(vocab: DataFrame, n_classes: int) -> DataFrame:
    """id, class and slot of each word by frequency rank; a class has ceil(words / classes) slots."""
    size = F.broadcast(vocab.agg(F.count("*").alias("v")))
    per = F.ceil(F.col("v") / n_classes)
    rank = F.col("id") - 1
    return vocab.crossJoin(size).select("id", "word", "freq", F.floor(rank / per).cast("long").alias("class"), (rank % per).cast("long").alias("slot"))


PADDING = -30.0  # fixed value: the bias of a slot without a word


def biases(classed: DataFrame) -> DataFrame:
    """class, slot, bias and class_bias: logarithms of frequencies plus a half, for every slot of every class; from `classes`."""
    c = classed.groupBy("class").agg(F.log(F.sum("freq") + 0.5).alias("class_bias"))
    width = classed.agg(F.max("slot").alias("most"))
    grid = c.crossJoin(F.broadcast(width)).select("class", "class_bias", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most"))).alias("slot"))
    got = grid.join(classed.select("class", "slot", "freq"), ["class", "slot"], "left")
    return got.select("class", "slot", F.coalesce(F.log(F.col("freq") + 0.5), F.lit(PADDING)).alias("bias"), "class_bias")
