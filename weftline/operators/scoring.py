"""Losses of a stream under any scorer, by strided windows.

A scorer is a function from windows (a list of arrays of ids) to log-probabilities: for each window an array with a value for
each token but the first. It is made once for each task, by what the function registered under its name gave when it was
fitted, and runs on batches of windows where they are; so a model in any library can take the place of the counts here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .ngrams import MOST_WORDS

Scorer = Callable[[list[np.ndarray]], list[np.ndarray]]
SCORERS: dict[str, Callable[..., Callable[[], Scorer]]] = {}
BATCH = 256  # windows that a scorer gets at a time


def scorer(name: str) -> Callable:
    """Register a function that fits a scorer: from a stream and options to a factory that tasks call."""

    def add(fit: Callable[..., Callable[[], Scorer]]) -> Callable[..., Callable[[], Scorer]]:
        SCORERS[name] = fit
        return fit

    return add


@scorer("uniform")
def uniform(train: DataFrame, size: int = 65536) -> Callable[[], Scorer]:
    return lambda: lambda windows: [np.full(len(w) - 1, -np.log(size)) for w in windows]


@scorer("unigram")
def unigram(train: DataFrame, size: int = 65536, add: float = 0.05) -> Callable[[], Scorer]:
    """Counts with additive smoothing over `size` words; `train` is a stream of ids below MOST_WORDS."""
    rows = train.select(F.explode("tokens").alias("id")).groupBy("id").agg(F.count("*").alias("c")).where(F.col("id").between(0, MOST_WORDS - 1)).collect()
    table = np.zeros(max([r.id for r in rows], default=0) + 1)
    for r in rows:
        table[r.id] = r.c
    shared = train.sparkSession.sparkContext.broadcast(np.log((table + add) / (table.sum() + add * size)))
    rest = float(np.log(add / (table.sum() + add * size)))

    def make() -> Scorer:
        known = shared.value
        return lambda windows: [np.where(w[1:] < len(known), known[np.minimum(w[1:], len(known) - 1)], rest) for w in windows]

    return make


def strided_losses(test: DataFrame, make: Callable[[], Scorer], window: int, stride: int) -> DataFrame:
    """begin, scored, nll of each window of a stream of ids; each target is scored once, in the first window that holds it."""
    b = tokens.blocks(test, stride, after=window - stride).select((F.col("block") * stride).alias("begin"), "first", "tokens")
    b = b.where((F.size("tokens") > 1) & ((F.col("begin") == 0) | (F.size("tokens") > window - stride)))
    scored = F.when(F.col("begin") == 0, F.size("tokens") - 1).otherwise(F.size("tokens") - (window - stride))
    rows = b.select("begin", scored.cast("long").alias("scored"), F.col("tokens").cast("array<long>").alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                windows = [part.column(2)[i].values.to_numpy() for i in range(part.num_rows)]
                took = part.column(1).to_pylist()
                nll = [-float(p[len(p) - n :].sum()) for p, n in zip(score(windows), took, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nll, pa.float64())], names=["begin", "scored", "nll"])

    return rows.mapInArrow(run, "begin long, scored long, nll double")


def perplexity(losses: DataFrame) -> DataFrame:
    """One row: n and ppl over all windows."""
    got = losses.agg(F.coalesce(F.sum("scored"), F.lit(0)).alias("n"), F.sum("nll").alias("nll"))
    return got.select("n", F.round(F.exp(F.try_divide("nll", "n")), 6).alias("ppl"))
