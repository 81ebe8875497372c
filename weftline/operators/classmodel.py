"""A word's probability in two stages, by counts: that of its class after the word before, and that of the word in its class.

Classes are slices of the frequency ranks (``vocab.classes``); the unknown word is a class of its own. P(class | before)
backs off to P(class) after a word that the training part doesn't have. So the tables hold (word, class), not (word, word).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .ngrams import wide_counts

ADD = 0.05  # fixed value: smoothing of both stages
UNKNOWN = -1  # the unknown word's class


def class_of(classed: DataFrame) -> DataFrame:
    """id, class and the number of words in the class, of all ids, 0 (unknown) included; one row for each word of the vocabulary."""
    rows = classed.select("id", "class")
    none = classed.sparkSession.range(1).select(F.lit(0).alias("id"), F.lit(UNKNOWN).cast("long").alias("class"))
    rows = rows.select(F.col("id").cast("int").alias("id"), "class").unionByName(none)
    return rows.join(rows.groupBy("class").agg(F.count("*").alias("size")), "class").select("id", "class", "size")


def cases(train: DataFrame, test: DataFrame, classed: DataFrame, n_classes: int) -> DataFrame:
    """x, y, times, p_class, p_word, p and seen of each distinct pair of test words; streams of ids, classes from `vocab.classes`.

    Equal pairs are counted before the joins; tables that have a row for each word of the bounded vocabulary are broadcast.
    """
    words = F.broadcast(class_of(classed))
    uni = wide_counts(train, 1).select(F.col("g1").alias("id"), F.col("cnt").alias("c"))
    per_class = uni.join(words, "id").groupBy("class").agg(F.sum("c").alias("cc"))
    pairs = wide_counts(train, 2).select(F.col("g1").alias("x"), F.col("g2").alias("id"), "cnt")
    follow = pairs.join(words, "id").groupBy("x", "class").agg(F.sum("cnt").alias("cxc"))
    before = pairs.groupBy("x").agg(F.sum("cnt").alias("cx"))
    total = F.broadcast(train.agg(F.sum("n").alias("total")))

    rows = tokens.contexts(test, 1).groupBy(F.element_at("context", 1).alias("x"), F.col("token").alias("id")).agg(F.count("*").alias("times"))
    rows = rows.join(words, "id").join(F.broadcast(uni), "id", "left").join(F.broadcast(per_class), "class", "left")
    rows = rows.join(F.broadcast(before), "x", "left").join(follow, ["x", "class"], "left").crossJoin(total)
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    own = (c("cc") + ADD) / (F.col("total") + ADD * (n_classes + 1))
    p_class = F.when(F.col("cx").isNull(), own).otherwise((c("cxc") + ADD) / (c("cx") + ADD * (n_classes + 1)))
    p_word = (c("c") + ADD) / (c("cc") + ADD * F.col("size"))
    got = rows.select("x", F.col("id").alias("y"), "times", p_class.alias("p_class"), p_word.alias("p_word"), F.col("cx").isNotNull().alias("seen"))
    return got.withColumn("p", F.col("p_class") * F.col("p_word"))


def report(rows: DataFrame) -> DataFrame:
    """One row: n, the perplexities of classes, of words in their classes and of words, and the share of known contexts."""
    mean = lambda x: F.try_divide(F.sum(F.col("times") * x), F.sum("times"))
    return rows.agg(
        F.coalesce(F.sum("times"), F.lit(0)).alias("n"),
        *[F.round(F.exp(mean(-F.log(p))), 6).alias(f"ppl_{name}") for name, p in (("class", "p_class"), ("in_class", "p_word"), ("word", "p"))],
        F.round(mean(F.col("seen").cast("double")), 9).alias("known"),
    )
