"""Running sums over an order, without gathering a group or the whole table in one task.

Rows are cut into ranges of the order that hold about equally many. Sums within a range are a window over (group, range);
sums over the ranges before are a second window over one row for each range, of which there are so many as the session
has partitions for, whatever the orders look like: close together, sparse, or repeated. An order that is repeated so often
that it fills several ranges is dealt among as many by a tie-break.
"""

from __future__ import annotations

from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 4096  # a smaller table than that is one range
MOST = 4096  # ranges
SUB = 1 << 20  # places for the parts of a repeated order within its range


def bounds(df: DataFrame, order: str, rows: int = ROWS) -> list:
    """Orders at which the ranges after the first begin; one that is there more than once fills several ranges."""
    most = min(MOST, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / most for k in range(1, most)] or [0.5]
    got = df.agg(F.count(order).alias("n"), F.percentile_approx(order, shares, F.lit(20 * most)).alias("q")).first()
    want = min(most, -(-got.n // rows))
    return [got.q[round(j * most / want) - 1] for j in range(1, want)] if want > 1 else []


def ranged(df: DataFrame, order: str, cuts: list, tie: Column | None, name: str) -> DataFrame:
    """df with `name`, the number of its range: it grows with the order (and the tie-break), nulls last."""
    times = Counter(cuts)
    splits = sorted({float(c) for c in times})
    if not splits:
        return df.withColumn(name, F.lit(0).cast("long"))
    got = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol=f"{name}d", outputCol=name, handleInvalid="keep").transform(df.withColumn(f"{name}d", F.col(order).cast("double")))
    part = F.lit(0)
    hot = {c: k for c, k in times.items() if k > 1}
    if hot and tie is not None:
        k = F.element_at(F.create_map(*[F.lit(x) for c, k in hot.items() for x in (c, k)]), F.col(order))
        u = F.floor((tie.cast("double") / F.lit(2.0**64) + 0.5) * k)
        part = F.when(k.isNotNull(), F.least(u, k - 1)).otherwise(F.lit(SUB - 1))  # what is behind a repeated order in its range comes last
    number = F.coalesce(F.col(name).cast("long"), F.lit(len(splits) + 2))
    return got.withColumn(name, (number * SUB + part).cast("long")).drop(f"{name}d")


BEFORE = 17  # rows before a row whose tails it gets


def running_before(df: DataFrame, order: str, value: Column, name: str, group: list[str] | None = None, rows: int = ROWS, tie: Column | None = None, tail: Column | None = None, spread: DataFrame | None = None) -> DataFrame:
    """df with `name`: the sum of `value` over the group's rows with a smaller `order` (a number; nulls come last).

    Rows of a group with the same order follow each other in the order of `tie`, a 64-bit hash of what tells them apart.
    With `tail` (of ungrouped rows), `tail` is an array of that column in at least the BEFORE rows before, in order. Those of
    the ranges before come from the last rows of each range, of which there are BEFORE at most. With `spread`, the ranges are
    those of its orders: rows that df leaves out, if finding which ones these are is dear.
    """
    group = group or []
    src = ranged(df, order, bounds(df if spread is None else spread, order, rows), tie, "__b")
    by = [F.asc_nulls_last(order), *([tie] if tie is not None else [])]
    inside = Window.partitionBy(*group, "__b").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    own = src.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    totals = src.groupBy(*group, "__b").agg(F.sum(value).alias("__t"))
    across = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__s", F.coalesce(F.sum("__t").over(across), F.lit(0))).drop("__t")
    if tail is not None:
        own = own.withColumn("__near", F.collect_list(tail).over(Window.partitionBy("__b").orderBy(*by).rowsBetween(-BEFORE, -1)))
        back = Window.partitionBy("__b").orderBy(F.desc_nulls_first(order), *([tie.desc()] if tie is not None else []))
        ends = src.select("__b", F.row_number().over(back).alias("__r"), tail.alias("__x")).where(F.col("__r") <= BEFORE)
        ends = ends.groupBy("__b").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("__r")).alias("r"), F.col("__x").alias("x")))), lambda e: e["x"]).alias("__e"))
        far = F.flatten(F.collect_list("__e").over(Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(-BEFORE, -1)))
        totals = totals.join(ends.select("__b", F.reverse(F.slice(F.reverse(far), 1, BEFORE)).alias("__far")), "__b")
    keys = [*group, "__b"]
    totals = totals.withColumnsRenamed({k: f"__r{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__r{k}")) for k in keys]
    got = own.join(totals if group else F.broadcast(totals), same)  # one row for each range
    more = {} if tail is None else {"tail": F.concat("__far", "__near")}
    return got.withColumns({name: F.col("__in") + F.col("__s"), **more}).drop("__b", "__in", "__s", "__near", "__far", *[f"__r{k}" for k in keys])
