"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HELD_OUT_MOD = 5
SUB_BATCH_BYTES = 2 << 20
BATCH_BYTES = 8 << 20  # of an Arrow batch, where Spark's own bound is larger
SLOTS = 1 << 20


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, mod 5; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_MOD


def held_out(id_col: str) -> Column:
    """True where labels must not be learnt from; a null id is not held out, but never learnt from either."""
    return F.coalesce(remainder(id_col) == 0, F.lit(False))


def learnable(id_col: str) -> Column:
    return F.coalesce(remainder(id_col) != 0, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Unset, a folder of this process will do in local mode; a cluster has to name one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="weftline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder. Spark deletes the files behind it with spark.cleaner.referenceTracking.cleanCheckpoints."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(name: str, *taken: list[str]) -> str:
    """`name` with as many underscores before it as keep it apart from all names taken, in any case of letters."""
    have = {c.lower() for names in taken for c in names}
    while name.lower() in have:
        name = f"_{name}"
    return name


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def slots_of(keys: DataFrame, key: str) -> DataFrame:
    """slot: the distinct remainders of hashed keys, to be broadcast. There are at most SLOTS, however many keys there are."""
    return F.broadcast(keys.select(F.pmod(F.col(key), F.lit(SLOTS)).alias("slot")).distinct())


def in_slots(rows: DataFrame, key: str, slots: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose hashed key may be among those that made the slots, or those whose key can't be.

    It spares a join most rows that would find no partner; with very many keys it spares fewer, and nothing else changes.
    """
    return rows.join(slots, F.pmod(F.col(key), F.lit(SLOTS)) == F.col("slot"), "left_semi" if inside else "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sub_batches(batch: pa.RecordBatch, text_at: int, most: int = SUB_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts together hold about `most` bytes; a longer text comes alone."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(text_at).fill_null("").cast(pa.large_string())
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset + 1 : col.offset + n + 1]
    first = int(np.frombuffer(col.buffers()[1], np.int64)[col.offset])
    lo = 0
    while lo < n:
        base = first if lo == 0 else int(ends[lo - 1])
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_texts(
    df: DataFrame,
    text_col: str,
    keep: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    most: int = SUB_BATCH_BYTES,
) -> DataFrame:
    """Columns of `keep` beside those that `make()(texts)` computes, batch by batch, without a shuffle.

    `make` runs once per task; its function gets about `most` bytes of text at a time, as a string array that may hold
    nulls. A kept column that is named as a computed one is left out: the result has the computed one. A table without rows
    gives none. The session's bound on the bytes of an Arrow batch is lowered to BATCH_BYTES and stays so, as the plan reads it
    when it runs.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b").removesuffix("b")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    new = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in new]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(unused("__text", keep, new)))
    schema = T.StructType([*src.schema.fields[:-1], *fields])
    at, names = len(keep), [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in sub_batches(batch, at, most):
                out = fn(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *out], names=names)
                del out
            pa.default_memory_pool().release_unused()

    return src.mapInArrow(run, schema)


def flat_utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and the n + 1 offsets; a null counts as empty."""
    col = texts.fill_null("").cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]
