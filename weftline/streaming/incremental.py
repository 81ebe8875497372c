"""Incremental runs over files that keep arriving, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import words

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, path: str, files_at_once: int = 6, schema: str = DOCUMENTS) -> DataFrame:
    """An unbounded source of Parquet files, so many in each round."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def word_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def run_to_end(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Give all that is there to `sink(rows, round)` and end; a later call goes on from the checkpoint."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return q


def replace_round(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each round as Parquet under its number, so that one which is run again replaces itself."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/round={number}")


def append_until(path: str, target: int, est: str = "est") -> Callable[[DataFrame, int], None]:
    """A sink that appends rounds as Parquet until the running sum of `est` has reached the target.

    A round is written under its number, and the sum up to it beside it, so one that is run again replaces both, and a round
    reads one row of the round before and none of the data.
    """

    def sink(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        have = spark.read.parquet(f"{path}_sums/round={number - 1}").first().s if number else 0
        out = f"{path}/round={number}"
        (rows if have < target else rows.limit(0)).write.mode("overwrite").parquet(out)
        total = spark.read.parquet(out).agg((F.coalesce(F.sum(est), F.lit(0)) + have).alias("s"))
        total.coalesce(1).write.mode("overwrite").parquet(f"{path}_sums/round={number}")

    return sink
