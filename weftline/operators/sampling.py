"""Hold-outs, weights, quotas, interleaving, stratified samples and deterministic draws."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import approx_tokens, md5_mod, unit_draw
from .prefix import running_before

MOST_SOURCES = 1_000_000


def holdout(convs: DataFrame, key: Column, mod: int = 500) -> DataFrame:
    """The rows with bucket (the key's md5 modulo `mod`) and held_out (bucket 0)."""
    return convs.withColumn("bucket", md5_mod(key, mod)).withColumn("held_out", F.col("bucket") == 0)


def capped_split(held: DataFrame, order: str, cap: int) -> DataFrame:
    """part: train, eval for the first `cap` held-out rows in the order, none for held-out rows behind them."""
    first = held.where("held_out").orderBy(order).limit(cap).select(F.col(order).alias("__o"), F.lit(True).alias("__e"))
    got = held.join(F.broadcast(first), F.col(order) == F.col("__o"), "left")
    return got.withColumn("part", F.when(~F.col("held_out"), "train").when(F.col("__e"), "eval").otherwise("none")).drop("__o", "__e")


def weights(sources: DataFrame, present: DataFrame, pool: int) -> DataFrame:
    """name, weight, quota of the sources that are there: weights sum to 1, quotas round half to even."""
    live = sources.join(present.select("name").distinct(), "name", "left_semi")
    w = F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0)))  # one row for each source
    return live.select("name", w.alias("weight")).withColumn("quota", F.bround(F.col("weight") * pool).cast("long"))


def quota_sample(docs: DataFrame, quotas: DataFrame) -> DataFrame:
    """The rows of each source that are drawn while what was written before is under its quota; the last may overshoot.

    docs: name, seq (whole number, unique in its source), text; rows without text are drawn and write nothing.
    """
    has = F.col("text").isNotNull() & (F.col("text") != "")
    rows = docs.withColumn("est", F.when(has, approx_tokens(F.col("text"))).otherwise(0))
    rows = running_before(rows, "seq", F.col("est"), "before", group=["name"], tie=F.xxhash64("text"))
    return rows.join(F.broadcast(quotas.select("name", "quota")), "name").where(F.col("before") < F.col("quota"))


def leavings(counts: np.ndarray) -> dict[str, np.ndarray]:
    """The phases of a round robin over sources with so many draws, in their order; each ends as one source leaves.

    Sources take turns. A source leaves when its turn comes and it has nothing left, which shifts the cycle of those behind
    it. Between two leavings the cycle is regular, so a phase is one row: who leaves, how many sources take part, at which
    of their places the phase starts, how many whole rounds it has, the place of the one who leaves, and the turns before it.
    """
    left, who = counts.astype(np.int64), np.arange(len(counts))
    out = {k: np.zeros(len(counts), np.int64) for k in ("who", "size", "first", "rounds", "gone", "turn")}
    turn = 0
    for p in range(len(counts)):
        size = len(left)
        first, rounds = turn % size, int(left.min())
        least = np.flatnonzero(left == rounds)
        k = int(np.searchsorted(least, first))
        gone = int(least[k % len(least)])  # the next in the cycle of those with the least left
        for name, x in (("who", who[gone]), ("size", size), ("first", first), ("rounds", rounds), ("gone", gone), ("turn", turn)):
            out[name][p] = x
        if rounds:
            left -= rounds
        if gone >= first:  # those whose turn comes before it have one more
            left[first:gone] -= 1
        else:
            left[first:] -= 1
            left[:gone] -= 1
        turn += rounds * size + (gone - first) % size + 1
        left, who = np.delete(left, gone), np.delete(who, gone)
    return out


def places(phases: dict[str, np.ndarray], source: int, nth: np.ndarray) -> np.ndarray:
    """The position in the interleaved order of a source's draws."""
    last = int(np.flatnonzero(phases["who"] == source)[0])  # the phase that ends as it leaves
    part = {k: v[: last + 1] for k, v in phases.items()}
    before = np.r_[0, np.cumsum(part["who"][:-1] < source)]  # sources in front of it that have left
    offset = (source - before - part["first"]) % part["size"]
    draws = part["rounds"] + (offset < (part["gone"] - part["first"]) % part["size"])
    drawn = np.r_[0, np.cumsum(draws)[:-1]]
    p = np.searchsorted(drawn, nth, "right") - 1
    return part["turn"][p] + offset[p] + (nth - drawn[p]) * part["size"][p] - p


def round_robin(drawn: DataFrame, order_of: list[str]) -> DataFrame:
    """The rows with `place`, their position in the interleaved order; drawn: name, nth (from 0 in its source).

    What is known of all sources is one count each and a row for each leaving; places are computed where the rows are.
    Rows of other sources than those named are left out.
    """
    counted = drawn.groupBy("name").agg(F.count("*").alias("n")).where(F.col("name").isNotNull())
    if len(order_of) > MOST_SOURCES:
        raise ValueError(f"at most {MOST_SOURCES} sources")
    have = {r.name: r.n for r in counted.join(F.broadcast(drawn.sparkSession.createDataFrame([(n,) for n in order_of], "name string")), "name", "left_semi").collect()}
    number = {n: i for i, n in enumerate(order_of)}
    phases = drawn.sparkSession.sparkContext.broadcast(leavings(np.array([have.get(n, 0) for n in order_of], np.int64)))
    schema = T.StructType([*drawn.schema.fields, T.StructField("place", T.LongType())])
    at = {c: drawn.columns.index(c) for c in ("name", "nth")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = b.column(at["name"]).dictionary_encode()
            ids, nth = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), b.column(at["nth"]).to_numpy(zero_copy_only=False)
            out = np.full(b.num_rows, -1, np.int64)
            for k, name in enumerate(coded.dictionary.to_pylist()):
                if name in number:
                    mine = ids == k
                    out[mine] = places(phases.value, number[name], nth[mine])
            rows = pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=schema.fieldNames())
            yield rows.filter(pa.array(out >= 0))

    return drawn.mapInArrow(run, schema)


def numbered(df: DataFrame, group: str, order: str) -> DataFrame:
    """nth: the row's number in its group, from 0."""
    return running_before(df, order, F.lit(1), "nth", group=[group], tie=F.xxhash64(*df.columns))


def class_subset(df: DataFrame, cls: str, classes: list) -> DataFrame:
    """The rows of some classes."""
    return df.where(F.col(cls).isin(*classes)) if classes else df.limit(0)


def stratified(df: DataFrame, cls: str, id_col: str, k: int, seed: str = "") -> DataFrame:
    """k rows of each class without replacement, those with the smallest md5 of the seeded id."""
    key = F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")).cast("binary"))
    order = Window.partitionBy(cls).orderBy(key, id_col)
    return df.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= k)


def trials(df: DataFrame, cls: str, id_col: str, k: int, n: int) -> DataFrame:
    """`n` repeated draws of k rows of each class: the rows with trial."""
    each = df.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    key = F.md5(F.concat_ws(":", F.col("trial"), F.col(id_col)).cast("binary"))
    order = Window.partitionBy("trial", cls).orderBy(key, id_col)
    return each.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= k)


def weighted_choice(key: Column, choices: list[tuple[str, float]]) -> Column:
    """One of the choices by cumulative weight, from a draw that the key's md5 gives."""
    total, acc, out = sum(w for _, w in choices), 0.0, None
    u = unit_draw(key)
    for name, w in choices:
        acc += w / total
        hit = u < F.lit(acc)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(choices[-1][0])


def negatives(key: Column, draw: Column, size: int) -> Column:
    """A slot in [0, size) by a hash of key and draw."""
    return F.floor(unit_draw(F.concat_ws(":", key, draw)) * size).cast("long")


def window_starts(n: int, key: Column, lo: Column, hi: Column, seed: int) -> Column:
    """n start positions in [lo, hi), as an array; the seed and the key draw them."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + F.floor(unit_draw(F.concat_ws(":", F.lit(seed), key, i)) * (hi - lo)).cast("long"))


def augmented(df: DataFrame, vec: str, id_col: str, scale: float = 0.05, turn: int = 1) -> DataFrame:
    """The rows and, with `copy` 1 to 4, a reversed, a rotated, a smoothly shifted and a noisy one of each."""
    v = F.col(vec).cast("array<double>")
    noise = lambda i: 2 * unit_draw(F.concat_ws(":", F.col(id_col), i)) - 1
    made = [
        v,
        F.reverse(v),
        F.concat(F.slice(v, turn + 1, F.greatest(F.size(v) - turn, F.lit(0))), F.slice(v, 1, turn)),
        F.transform(v, lambda x, i: x + F.lit(scale) * F.sin(i.cast("double"))),
        F.transform(v, lambda x, i: x + F.lit(scale) * noise(i)),
    ]
    rest = [F.col(f"`{c}`") for c in df.columns if c != vec]
    return df.select(*rest, F.posexplode(F.array(*made)).alias("copy", vec))


def placed(df: DataFrame, key: str) -> DataFrame:
    """The rows with `place`, their number in the order of a key, from 0; equal keys by a hash of the row."""
    return running_before(df, key, F.lit(1), "place", tie=F.xxhash64(*df.columns))


def shuffled(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """The rows with `place` in a seeded order that doesn't depend on how they are stored."""
    key = unit_draw(F.concat_ws(":", F.lit(seed), F.col(id_col)))
    return placed(df.withColumn("__key", key), "__key").drop("__key")
