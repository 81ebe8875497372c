"""Functions on arrays of numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def unit(a: Column) -> Column:
    """The vector divided by its norm; null if that is 0."""
    n = F.nullif(norm(a), F.lit(0.0))
    return F.when(n.isNotNull(), F.transform(doubles(a), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def logsumexp(a: Column) -> Column:
    top = F.array_max(doubles(a))
    return top + F.log(_sum(F.transform(doubles(a), lambda x: F.exp(x - top))))


def softmax(a: Column, floor: float = 0.0) -> Column:
    """exp(x - max) / (sum + floor)."""
    top = F.array_max(doubles(a))
    e = F.transform(doubles(a), lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / (_sum(e) + floor))


def argmax(a: Column) -> Column:
    """Place of the largest value, from 0; of several the first."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def winners(a: Column, k: int) -> Column:
    """1 where a value is among the k largest, ties at the k-th included; else 0."""
    cut = F.element_at(F.sort_array(a, asc=False), F.least(F.lit(k), F.size(a)))
    return F.transform(a, lambda x: (x >= cut).cast("int"))


def top_margins(a: Column, k: int) -> Column:
    """The k largest as (idx, margin over the next one), by value, ties by place; k must be under the length."""
    pairs = F.transform(a, lambda x, i: F.struct((-x).alias("neg"), i.alias("idx")))
    ordered = F.array_sort(pairs)
    nxt = -F.element_at(ordered, k + 1)["neg"]
    return F.transform(F.slice(ordered, 1, k), lambda s: F.struct(s["idx"].alias("idx"), (-s["neg"] - nxt).alias("margin")))


def grouped_top(a: Column, groups: int, m: int, k: int) -> Column:
    """Approximate top k: the m largest of each of so many equal parts, then the k largest of those; places only."""
    pairs = F.transform(a, lambda x, i: F.struct((-x).alias("neg"), i.alias("idx")))
    width = F.ceil(F.size(a) / groups).cast("int")
    first = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.slice(F.array_sort(F.slice(pairs, g * width + 1, width)), 1, m)))
    return F.transform(F.slice(F.array_sort(first), 1, k), lambda s: s["idx"])


def _with(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def log_softmax(a: Column) -> Column:
    return _with(logsumexp(a), lambda all_: F.transform(doubles(a), lambda x: x - all_))


def _mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def divisive(a: Column) -> Column:
    """The vector divided by its root mean square."""
    scale = F.sqrt(_mean(F.transform(doubles(a), lambda x: x * x))) + 1e-6
    return _with(scale, lambda s: F.transform(doubles(a), lambda x: x / s))


def contrast(a: Column) -> Column:
    """The vector without its mean, divided by its deviation."""
    free = _with(_mean(doubles(a)), lambda m: F.transform(doubles(a), lambda x: x - m))
    scale = lambda v: F.sqrt(_mean(F.transform(v, lambda x: x * x))) + 1e-4
    return _with(free, lambda v: _with(scale(v), lambda s: F.transform(v, lambda x: x / s)))


def relu(a: Column, threshold: float = 0.0) -> Column:
    """Values above the threshold, less it; 0 for the others."""
    return F.transform(doubles(a), lambda x: F.greatest(x - threshold, F.lit(0.0)))


def awake(a: Column, k: int) -> Column:
    """The k strongest values, ties at the k-th included, and 0 for the others; with k values or fewer all stay."""
    return F.when(F.size(a) <= k, doubles(a)).otherwise(F.zip_with(doubles(a), winners(a, k), lambda x, w: x * w))
