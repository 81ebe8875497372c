"""Evaluation metrics over predictions, scores and usage counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running_before


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def per_class(rows: DataFrame, classes: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """class, recall, precision, f1, support of every class of the full list; 0 where a denominator is 0."""
    real = rows.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("support"), F.count_if(F.col(label) == F.col(pred)).alias("hit"))
    said = rows.groupBy(F.col(pred).alias("class")).agg(F.count("*").alias("said"))
    got = classes.join(real, "class", "left").join(said, "class", "left").na.fill(0)
    r, p = _ratio(F.col("hit"), F.col("support")), _ratio(F.col("hit"), F.col("said"))
    return got.select("class", F.round(r, 9).alias("recall"), F.round(p, 9).alias("precision"), F.round(_ratio(2 * r * p, r + p), 9).alias("f1"), "support")


def confusion(rows: DataFrame, classes: list[int], label: str = "label", pred: str = "pred") -> DataFrame:
    """label, and a column p<class> for each class with how often it was predicted; zeros included."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(c,) for c in classes], f"{label} int")
    got = rows.groupBy(label).pivot(pred, classes).count()
    return every.join(got, label, "left").na.fill(0).select(label, *[F.col(f"`{c}`").alias(f"p{c}") for c in classes])


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of counts over examples that both sides predicted: inputs (query_id, label, pred)."""
    rows = a.join(b.select("query_id", F.col("pred").alias("other")), "query_id")
    x, y = F.col("pred") == F.col("label"), F.col("other") == F.col("label")
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("pred") == F.col("other")).alias("agree"),
        F.count_if(x & y).alias("both_right"),
        F.count_if(~x & ~y).alias("both_wrong"),
        F.count_if(x & ~y).alias("a_only"),
        F.count_if(~x & y).alias("b_only"),
        F.count_if(F.col("pred") != F.col("other")).alias("disagree"),
    )


def committee(experts: DataFrame) -> DataFrame:
    """a, b, agree for each pair of experts, and a = b with the expert's accuracy; input (expert, query_id, label, pred)."""
    other = experts.select(F.col("expert").alias("b"), "query_id", F.col("pred").alias("pred_b"))
    pairs = experts.join(other, "query_id").where("expert < b").groupBy(F.col("expert").alias("a"), "b").agg(F.round(F.avg((F.col("pred") == F.col("pred_b")).cast("double")), 9).alias("agree"))
    solo = experts.groupBy(F.col("expert").alias("a")).agg(F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), 9).alias("agree")).select("a", F.col("a").alias("b"), "agree")
    return solo.unionByName(pairs)


def ensemble(voted: DataFrame) -> DataFrame:
    """query_id, pred: class probabilities summed over experts, ties to the smallest label; input (query_id, label, p)."""
    s = voted.groupBy("query_id", "label").agg(F.sum("p").alias("p"))
    return s.groupBy("query_id").agg(F.max_by("label", F.struct(F.round("p", 9).alias("p"), (-F.col("label")).alias("l"))).alias("pred"))


def head_to_head(rows: DataFrame, a: str, b: str, tolerance: float = 1.001, times: str | None = None) -> DataFrame:
    """n, a_wins, b_wins, ties: a wins where its probability exceeds b's by more than 0.1 %; a row counts `times`, or once."""
    x, y, m = F.col(a), F.col(b), F.col(times) if times else F.lit(1)
    wins_a, wins_b = x > y * tolerance, y > x * tolerance
    total = lambda which: F.coalesce(F.sum(F.when(which, m)), F.lit(0)).cast("long")
    return rows.agg(total(F.lit(True)).alias("n"), total(wins_a).alias("a_wins"), total(wins_b).alias("b_wins"), total(~wins_a & ~wins_b).alias("ties"))


def topk(voted: DataFrame, truth: DataFrame) -> DataFrame:
    """n, ppl, bits, top1, top5, top10: a case's rank is the number of labels with a strictly larger probability."""
    real = truth.join(voted, ["query_id", "label"], "left").select("query_id", F.coalesce("p", F.lit(0.0)).alias("py"))
    better = voted.join(real, "query_id").where("p > py").groupBy("query_id").agg(F.count("*").alias("better"))
    rows = real.join(better, "query_id", "left").select(F.coalesce("better", F.lit(0)).alias("better"), F.greatest("py", F.lit(1e-12)).alias("py"))
    nll = F.avg(-F.log("py"))
    acc = [F.round(F.avg((F.col("better") < k).cast("double")), 9).alias(f"top{k}") for k in (1, 5, 10)]
    return rows.agg(F.count("*").alias("n"), F.round(F.exp(nll), 6).alias("ppl"), F.round(nll / F.log(F.lit(2.0)), 6).alias("bits"), *acc)


def gini(usage: DataFrame, count: str = "count") -> DataFrame:
    """units, dead (share of zeros), mean and gini of usage counts, zeros included; 0 for an empty or unused table.

    Equal counts need no order among them: counts are grouped first, so the window runs over distinct counts.
    """
    by = usage.groupBy(F.col(count).cast("double").alias("x")).agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = by.withColumn("b", before)
    # sum over i of (2i - G - 1) x with i = b+1 .. b+m
    term = F.col("x") * (2 * (F.col("m") * F.col("b") + F.col("m") * (F.col("m") + 1) / 2))
    out = g.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("units"), F.sum(term).alias("t"), F.sum(F.col("x") * F.col("m")).alias("s"), F.coalesce(F.sum(F.when(F.col("x") == 0, F.col("m"))), F.lit(0)).alias("zero"))
    value = F.try_divide(F.col("t") - (F.col("units") + 1) * F.col("s"), F.col("units") * F.col("s"))
    return out.select("units", F.round(_ratio(F.col("zero"), F.col("units")), 9).alias("dead"), F.round(_ratio(F.col("s"), F.col("units")), 9).alias("mean"), F.round(F.coalesce(value, F.lit(0.0)), 9).alias("gini"))


def scoreboard(rows: DataFrame) -> DataFrame:
    """place, model, ppl, error: by perplexity, models that failed behind the others in the order of `seq`."""
    order = Window.orderBy(F.asc_nulls_last("ppl"), "seq")
    return rows.select(F.row_number().over(order).alias("place"), "model", "ppl", "error")


def smoothed_series(rows: DataFrame, group: str, order: str, value: str, keep: float = 0.85) -> DataFrame:
    """group, n, best (smallest so far, so of all), ema (keep * old + rest * new, from the first value), mean of the last 10, deviation of the last 30.

    order: a whole number, unique in its group. The recurrence is a sum weighted by the values' places from the end, so a
    group of any size is pre-aggregated and never gathered.
    """
    own = rows.where(F.col(value).isNotNull()).select(group, (-F.col(order).cast("long")).alias("__o"), F.col(value).cast("double").alias("__x"))
    own = running_before(own, "__o", F.lit(1), "__k", group=[group])  # how many values come later
    x, k = F.col("__x"), F.col("__k")
    first = F.max_by("__x", "__k")
    steps = F.sum((1 - keep) * x * F.pow(F.lit(keep), k))
    got = own.groupBy(group).agg(F.count("*").alias("n"), F.min("__x").alias("best"), (steps + keep * first * F.pow(F.lit(keep), F.max("__k"))).alias("ema"), F.avg(F.when(k < 10, x)).alias("last10"), F.stddev_pop(F.when(k < 30, x)).alias("sd30"))
    return got.select(group, "n", "best", F.round("ema", 6).alias("ema"), F.round("last10", 6).alias("last10"), F.round("sd30", 4).alias("sd30"))


def shares(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, percent of the total."""
    s = rows.groupBy(key).agg(F.sum(value).alias(value))
    return s.crossJoin(F.broadcast(s.agg(F.sum(value).alias("__all")))).select(key, value, F.round(100 * F.try_divide(F.col(value).cast("double"), F.col("__all")), 6).alias("percent"))


def feature_stats(df: DataFrame, vec: str) -> DataFrame:
    """i, mean, sd of each component of the vectors."""
    return df.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(F.round(F.avg("x"), 9).alias("mean"), F.round(F.stddev_pop("x"), 9).alias("sd"))


def layers(run: DataFrame, other: DataFrame, arrays: list[str]) -> DataFrame:
    """layer and one column for each of the run's arrays, zipped by place, beside the columns of the other run; one row each."""
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    rest = [c for c in run.columns if c not in arrays]
    return run.crossJoin(F.broadcast(other)).select(*rest, *other.columns, F.posexplode(zipped).alias("layer", "z")).select(*rest, *other.columns, "layer", *[F.col(f"z.{a}").alias(a) for a in arrays])


def trends(rows: DataFrame, group: str, order: str, value: str, span: int = 60, least: float = 1e-4, size: int = 4096) -> DataFrame:
    """group, order, value, n and mean of the last `span` values, best so far, and the trend against the value before.

    A group is cut into parts of `size` rows, and a part gets the last `span` rows of the one before, so that a long series
    is many tasks; the best of the parts before comes from one row for each.
    """
    own = rows.where(F.col(value).isNotNull()).select(group, order, F.col(value).cast("double").alias(value))
    own = running_before(own, order, F.lit(1), "__k", group=[group]).withColumn("__b", F.floor(F.col("__k") / size))
    after = own.where(F.col("__k") % size >= size - span).withColumn("__b", F.col("__b") + 1)
    both = own.withColumn("__own", F.lit(True)).unionByName(after.withColumn("__own", F.lit(False)))
    by = Window.partitionBy(group, "__b").orderBy("__k")
    last, so_far = by.rowsBetween(1 - span, Window.currentRow), by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    old = F.lag(value).over(by)
    trend = F.when(old.isNull(), "none").when(F.col(value) < old - least, "down").when(F.col(value) > old + least, "up").otherwise("same")
    got = both.select(group, order, value, "__b", "__own", F.count("*").over(last).alias("n"), F.round(F.avg(value).over(last), 9).alias("mean"), F.min(F.when(F.col("__own"), F.col(value))).over(so_far).alias("__m"), trend.alias("trend")).where("__own")
    parts = own.groupBy(group, "__b").agg(F.min(value).alias("__p"))
    earlier = F.min("__p").over(Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col(group).alias("__g"), F.col("__b").alias("__c"), earlier.alias("__e"))
    got = got.join(parts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__c")))
    return got.select(group, order, value, "n", "mean", F.least("__m", "__e").alias("best"), "trend")


def run_report(rows: DataFrame, kind: str, ok: Column) -> DataFrame:
    """kind, tried, accepted, failed and rate (accepted of those tried)."""
    got = rows.groupBy(kind).agg(F.count("*").alias("tried"), F.count_if(F.coalesce(ok, F.lit(False))).alias("accepted"))
    return got.select(kind, "tried", "accepted", (F.col("tried") - F.col("accepted")).alias("failed"), F.round(F.col("accepted") / F.col("tried"), 9).alias("rate"))


def covariance(df: DataFrame, vec: str, size: int) -> DataFrame:
    """i, j (i <= j) and cov of the components of vectors of one size: sums of products of each task, added up."""
    src = df.select(F.col(vec).cast("array<double>").alias("v")).where((F.size("v") == size) & ~F.exists("v", lambda x: x.isNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(size), np.zeros((size, size))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        i, j = np.triu_indices(size)
        cols = [i, j, np.full(len(i), n), s[i], s[j], p[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 3), strict=True)], names=["i", "j", "n", "a", "b", "p"])

    part = src.mapInArrow(run, "i int, j int, n long, a double, b double, p double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "nabp"])
    return part.where("n > 0").select("i", "j", F.round(F.col("p") / F.col("n") - F.col("a") / F.col("n") * F.col("b") / F.col("n"), 9).alias("cov"))
