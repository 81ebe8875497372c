"""Writers. Paths may be in any storage that Spark writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tokens(stream: DataFrame, path: str) -> None:
    """A token stream as Parquet; it holds as many tokens as there are, and no unused room."""
    stream.write.mode("overwrite").parquet(path)


def eval_tokens(stream: DataFrame, path: str, budget: int) -> None:
    from ..operators.tokens import clamp

    clamp(stream, budget).write.mode("overwrite").parquet(path)


def manifest(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def jsonl(rows: DataFrame, path: str, *cols: str) -> None:
    """Append rows as JSON lines; letters beyond ASCII stay."""
    rows.select(F.to_json(F.struct(*(cols or rows.columns))).alias("value")).write.mode("append").text(path)


def scoreboard(ranked: DataFrame, path: str, reference: float | None = None) -> None:
    """Ranked rows and a reference value as one JSON object."""
    row = F.struct("place", "model", "ppl", "error")
    one = ranked.agg(F.array_sort(F.collect_list(row)).alias("results")).withColumn("reference", F.lit(reference).cast("double"))
    one.select(F.to_json(F.struct("reference", "results"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def detokenized(rows: DataFrame, vocab: DataFrame, ids: str = "ids") -> DataFrame:
    """The rows with `text`: their ids' words joined by blanks."""
    keys = [c for c in rows.columns if c != ids]
    each = rows.select(*keys, F.posexplode(ids).alias("__i", "id")).join(vocab.select("id", "word"), "id", "left")
    return each.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", F.coalesce("word", F.lit("<unk>")).alias("w")))), lambda s: s["w"]), " ").alias("text"))
