"""Readers. All go through Spark, so any storage that Spark reads will do."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import records

TURNS = "struct<messages:array<struct<role:string,content:string>>,category:string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The sources that load; one that is missing is left out, not fatal."""
    found = {}
    for name, path in paths.items():
        try:
            found[name] = spark.read.parquet(path)
        except AnalysisException:
            continue
    return found


def jsonl(lines: DataFrame, line: str = "value") -> DataFrame:
    """messages and category of JSON lines; blank, broken and empty ones are skipped."""
    got = lines.where(F.trim(line) != "").select(F.from_json(F.col(line), TURNS).alias("r"))
    return got.where(F.size("r.messages") > 0).select("r.messages", "r.category")


def jsonl_files(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """The same of files, with their path, in the order of the paths and of the lines in each; no pattern gives no rows."""
    if not patterns:
        return spark.createDataFrame([], "messages array<struct<role:string,content:string>>, category string, path string")
    rows = spark.read.text(patterns).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    got = rows.where(F.trim("value") != "").select(F.from_json("value", TURNS).alias("r"), "path", "block", "row")
    got = got.where(F.size("r.messages") > 0).select("r.messages", "r.category", "path", "block", "row")
    return got.orderBy("path", "block", "row").drop("block", "row")


def plain_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows of text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A JSON sidecar as one row; None if it is missing or broken."""
    try:
        rows = spark.read.schema(schema + ", __bad string").json(path, multiLine=True, columnNameOfCorruptRecord="__bad").where("__bad IS NULL").drop("__bad")
        return rows if rows.take(1) else None
    except AnalysisException:
        return None


def reusable(spark: SparkSession, path: str, want: dict[str, object], schema: str) -> bool:
    """Whether a cache's sidecar says what is wanted: model, vocabulary, type and at least the budget."""
    got = sidecar(spark, path, schema)
    if got is None:
        return False
    row = got.first().asDict()
    return all(row.get(k) == v for k, v in want.items() if k != "train_tokens") and (row.get("train_tokens") or 0) >= want.get("train_tokens", 0)


def token_files(spark: SparkSession, path: str, dtype: str = "uint32", range_bytes: int = records.RANGE_BYTES) -> DataFrame:
    """path, pos (in its file), id (through all files, by path) and token of headerless token files; a rest shorter than a token is ignored.

    Files are read in ranges. Long, as uint32 has no signed type.
    """
    return records.records(spark, path, dtype=dtype, range_bytes=range_bytes).withColumnRenamed("value", "token")


def images(spark: SparkSession, path: str, pixels: int, range_bytes: int = records.RANGE_BYTES) -> DataFrame:
    """id, x (floats from 0 to 1) of files of 8-bit pixels, numbered through all files; a size that isn't a multiple fails."""
    return records.records(spark, path, dtype="uint8", width=pixels, scale=255, rest="fail", range_bytes=range_bytes).select("id", F.col("values").alias("x"))


def labels(spark: SparkSession, path: str, range_bytes: int = records.RANGE_BYTES) -> DataFrame:
    """id, label of files of 8-bit labels, numbered as the images beside them are."""
    return records.records(spark, path, dtype="uint8", range_bytes=range_bytes).select("id", F.col("value").cast("int").alias("label"))


def test_split(stream: DataFrame, most: int) -> DataFrame:
    """A stream's non-empty documents until `most` tokens are reached, the last one cut."""
    from ..operators.tokens import clamp

    return clamp(stream.where("n > 0"), most)


def synthetic(spark: SparkSession, kind: str, n: int, seed: int = 0) -> DataFrame:
    """id, x, label of made-up rows: `bits` (label: more than half of ten are 1), `xor` (two noisy coordinates) or `template` (noisy 5 x 5 shapes)."""
    rows = spark.range(n)
    u = lambda i: (F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    if kind == "bits":
        x = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (u(i) < 0.5).cast("float"))
        return rows.select("id", x.alias("x")).withColumn("label", (F.aggregate("x", F.lit(0.0), lambda s, v: s + v) > 5).cast("int"))
    if kind == "xor":
        a, b = (u(F.lit(0)) < 0.5).cast("int"), (u(F.lit(1)) < 0.5).cast("int")
        x = F.array(*[(c + 0.2 * (u(F.lit(k)) - 0.5) * 2).cast("float") for k, c in ((2, a), (3, b))])
        return rows.select("id", x.alias("x"), a.bitwiseXOR(b).alias("label"))
    if kind == "template":
        label = F.pmod(F.col("id"), F.lit(4)).cast("int")

        def lit_at(i):
            r, c = F.floor(i / 5), i % 5
            return F.when(label == 0, r == 2).when(label == 1, c == 2).when(label == 2, (r == 2) | (c == 2)).otherwise((r == c) | (r + c == 4))

        x = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: (lit_at(i) != (u(i) < 0.12)).cast("float"))
        return rows.select("id", x.alias("x"), label.alias("label"))
    raise ValueError(kind)


def frozen_split(df: DataFrame, id_col: str, train: int, seed: int = 0) -> DataFrame:
    """The rows with `part`: the first `train` in a seeded order are train, the rest test."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col)).cast("binary"))
    first = df.select(key.alias("__k"), id_col).orderBy("__k", id_col).limit(train).select(F.col(id_col).alias("__id"), F.lit(True).alias("__t"))
    return df.join(first, F.col(id_col) == F.col("__id"), "left").withColumn("part", F.when(F.col("__t"), "train").otherwise("test")).drop("__id", "__t")
