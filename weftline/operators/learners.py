"""Models over vectors that are fitted by rounds of partial sums: a softmax classifier and a dictionary of directions.

What tasks add up are whole numbers: vectors and errors are rounded to fixed steps first, so sums are exact, and a model
does not depend on how rows are dealt to partitions, on their order, or on tasks that run again. Each round sends the driver
one sum for each parameter. Rows are written once before the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

STEP = 2.0**-12  # of a vector's component
ERROR = 2.0**-18  # of a class probability's error
BATCH = 4096  # rows whose sums are formed together: far below 2^53 units
MOST = 1 << 17  # steps of a component


def matrix(col: pa.Array, size: int) -> np.ndarray:
    """Vectors of one length as whole numbers of steps."""
    x = np.rint(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size) / STEP)
    if len(x) and np.abs(x).max() > MOST:
        raise ValueError(f"a component is beyond {MOST * STEP}")
    return x


def usable(df: DataFrame, vec: str, size: int, *more: str) -> DataFrame:
    """The rows whose vector has `size` components, none null or non-finite, as `v`."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    got = df.select(*more, F.col(vec).cast("array<double>").alias("v")).where(F.size("v") == size)
    return got.where(~F.exists("v", bad))


def summed(df: DataFrame, size: int, fn) -> np.ndarray:
    """Exact sums of the whole numbers that ``fn(batch)`` gives, an array of `size`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                total += fn(b.slice(lo, BATCH)).astype(np.int64).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "s"])

    out = np.zeros(size, np.int64)
    for r in df.mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect():  # one row for each parameter
        out[r.i] = r.s
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.c_[x, np.full(len(x), 1 / STEP)]


def fit_softmax(df: DataFrame, vec: str, label: str, size: int, classes: int, rounds: int = 30, rate: float = 1.0) -> np.ndarray:
    """Weights (size + 1, classes; the last row is the bias) by descent on the mean loss; labels are 0 to classes - 1, other rows are left out."""
    rows = cut(usable(df.where(F.col(label).between(0, classes - 1)), vec, size, F.col(label).cast("int").alias("y")))
    n, w = rows.count(), np.zeros((size + 1, classes))
    if not n:
        return w

    for _ in range(rounds):

        def gradient(b: pa.RecordBatch, w=w) -> np.ndarray:
            x = with_bias(matrix(b.column(1), size))
            p = softmax(x * STEP @ w)
            p[np.arange(len(p)), b.column(0).to_numpy()] -= 1
            return x.T @ np.rint(p / ERROR)

        w = w - rate * summed(rows, w.size, gradient).reshape(w.shape) * (STEP * ERROR / n)
    return w


def classified(df: DataFrame, vec: str, w: np.ndarray, *keep: str) -> DataFrame:
    """`keep` (names), pred (ties to the smaller class) and p of each usable vector."""
    size = len(w) - 1
    src = usable(df, vec, size, *keep)
    names = src.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = softmax(with_bias(matrix(b.column(len(names)), size)) * STEP @ w)
            best = np.round(p, 12).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(best.astype(np.int32)), pa.array(p[np.arange(len(p)), best])], names=[*names, "pred", "p"])

    return src.mapInArrow(run, f"{schema}, pred int, p double")


class Dictionary:
    """Mean, projection to whitened directions, unit codewords, and what each round reached: the mean cosine-like match."""

    def __init__(self, mean: np.ndarray, projection: np.ndarray, words: np.ndarray, reached: list[float]):
        self.mean, self.projection, self.words, self.reached = mean, projection, words, reached

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.projection

    def matches(self, x: np.ndarray) -> np.ndarray:
        return np.round(self.project(x) @ self.words.T, 9)


def fit_dictionary(df: DataFrame, vec: str, id_col: str, size: int, keep: int, words: int, rounds: int = 10, epsilon: float = 1e-2) -> Dictionary | None:
    """Whiten along the `keep` directions of the largest variance, then spherical k-means; None without rows.

    Codewords start at the vectors with the smallest md5 of their id, made to length 1. Each round gives a codeword the
    direction of the sum of its vectors; one that no vector matches best stays as it is. Ties go to the smaller codeword.
    """
    rows = cut(usable(df.where(F.col(id_col).isNotNull()), vec, size, F.col(id_col).cast("string").alias("id")))
    n = rows.count()
    if not n:
        return None
    mean = summed(rows, size, lambda b: matrix(b.column(1), size).sum(0)) * STEP / n

    def products(b: pa.RecordBatch) -> np.ndarray:
        x = matrix(b.column(1), size)
        return x.T @ x

    cov = summed(rows, size * size, products).reshape(size, size) * STEP**2 / n - np.outer(mean, mean)
    value, direction = np.linalg.eigh(cov)
    top = np.argsort(-value, kind="stable")[:keep]
    projection = direction[:, top] / np.sqrt(np.maximum(value[top], 0) + epsilon)
    own = Dictionary(mean, projection, np.zeros((0, keep)), [])

    first = rows.withColumn("k", F.md5(F.col("id").cast("binary"))).orderBy("k", "v").limit(words).collect()
    start = own.project(np.rint(np.array([r.v for r in first]) / STEP) * STEP)
    own.words = start / (np.linalg.norm(start, axis=1, keepdims=True) + 1e-8)
    for _ in range(rounds):

        def gathered(b: pa.RecordBatch, own=own) -> np.ndarray:
            z = own.project(matrix(b.column(1), size) * STEP)
            m = np.round(z @ own.words.T, 9)
            best, out = m.argmax(1), np.zeros((len(own.words), keep + 1))
            np.add.at(out[:, :keep], best, np.rint(z / ERROR))
            np.add.at(out[:, keep], best, np.rint(m[np.arange(len(m)), best] / ERROR))
            return out

        got = summed(rows, len(own.words) * (keep + 1), gathered).reshape(len(own.words), -1)
        own.reached.append(float(got[:, keep].sum()) * ERROR / n)
        length = np.linalg.norm(got[:, :keep], axis=1, keepdims=True)
        own.words = np.where(length > 0, got[:, :keep] / np.maximum(length, 1e-300), own.words)
    return own


def encoded(df: DataFrame, vec: str, id_col: str, size: int, own: Dictionary) -> DataFrame:
    """id, word (the best codeword), match, and code: each codeword's match above the mean of all, 0 below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = own.matches(matrix(b.column(1), size) * STEP)
            best = m.argmax(1)
            code = np.maximum(m - m.mean(1, keepdims=True), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int32)), pa.array(m[np.arange(len(m)), best]), pa.array(list(code), pa.list_(pa.float64()))], names=["id", "word", "match", "code"])

    return usable(df, vec, size, F.col(id_col).alias("id")).mapInArrow(run, "id long, word int, match double, code array<double>")

