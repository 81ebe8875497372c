"""Headerless files of fixed-size records, such as tokens or images, read and written in parts.

``spark.read.format("fixed_records")`` reads files in byte ranges, a task for each, so that a file of any size is shared out.
Files are taken in the order of their paths and records are numbered through all of them, from sizes alone; ``id`` is that
number, ``pos`` the one in the file. Options: ``path`` (a file, a folder, or a pattern in the path's last part), ``dtype`` (a
little-endian numpy type), ``width`` (values in a record: 1 gives ``value``, a long; more give ``values``, floats),
``scale`` (what values are divided by), ``range_bytes``, and ``rest``: what becomes of bytes at a file's end that are no
whole record, ``drop`` or ``fail``.

``df.write.format("fixed_records")`` writes rows of (start, tokens) in the order of start: a file for each task, named by its
first position, so that reading them gives the order again. A file appears under its name only when all tasks are done,
and what tasks wrote that failed or ran twice is deleted. ``meta.json`` beside them has the number of tokens and their type.

Any storage that Arrow's file systems know will do.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RANGE_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
NAME = "fixed_records"


def file_system(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path) if ":/" in path else (afs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """Path and size of the files, by path; names that begin with a dot or an underscore and JSON are none of them."""
    fs, at = file_system(path)
    folder, name = posixpath.split(at.rstrip("/"))
    if any(c in name for c in "*?["):
        found = [f for f in fs.get_file_info(afs.FileSelector(folder)) if fnmatch.fnmatch(f.base_name, name)]
    else:
        one = fs.get_file_info(at.rstrip("/"))
        if one.type == afs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = fs.get_file_info(afs.FileSelector(at)) if one.type == afs.FileType.Directory else [one]
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "._" and not f.base_name.endswith(".json"))


@dataclass
class Range(InputPartition):
    path: str
    lo: int  # records of the file
    hi: int
    first: int  # id of the file's first record


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.dtype, self.width = np.dtype(options.get("dtype", "uint32")).newbyteorder("<"), int(options.get("width", 1))
        self.scale, self.span = float(options.get("scale", 1)), int(options.get("range_bytes", RANGE_BYTES))
        self.rest = options.get("rest", "drop")
        self.size = self.dtype.itemsize * self.width

    def partitions(self) -> list[Range]:
        out, first, step = [], 0, max(1, self.span // self.size)
        for path, size in listed(self.path):
            if size % self.size and self.rest == "fail":
                raise ValueError(f"{path}: {size} bytes are no multiple of {self.size}")
            n = size // self.size
            out += [Range(path, lo, min(n, lo + step), first) for lo in range(0, n, step)]
            first += n
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.hi == part.lo:
            return
        fs, _ = file_system(self.path)
        step = max(1, BATCH_BYTES // self.size)
        with fs.open_input_file(part.path) as f:
            for lo in range(part.lo, part.hi, step):
                n = min(step, part.hi - lo)
                raw = f.read_at(n * self.size, lo * self.size)
                x = np.frombuffer(raw, self.dtype, n * self.width)
                pos = np.arange(lo, lo + n)
                cols = [pa.array([part.path]).take(pa.array(np.zeros(n, np.int8))), pa.array(pos), pa.array(pos + part.first)]
                if self.width == 1:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(x.astype(np.int64))], names=["path", "pos", "id", "value"])
                else:
                    values = pa.array((x / np.float32(self.scale)).astype(np.float32))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.width), values)
                    yield pa.RecordBatch.from_arrays([*cols, lists], names=["path", "pos", "id", "values"])


@dataclass
class Written(WriterCommitMessage):
    path: str
    first: int
    n: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.dtype, self.overwrite = options["path"], np.dtype(options.get("dtype", "uint32")).newbyteorder("<"), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, at = file_system(self.path)
        fs.create_dir(at, recursive=True)
        path, first, n = f"{at}/_{uuid.uuid4().hex}", -1, 0
        most = np.iinfo(self.dtype).max
        with fs.open_output_stream(path) as f:
            for b in batches:
                start, tokens = b.column(b.schema.get_field_index("start")), b.column(b.schema.get_field_index("tokens"))
                if not b.num_rows:
                    continue
                first = start[0].as_py() if first < 0 else first
                x = tokens.flatten().to_numpy(zero_copy_only=False)
                if len(x) and (x.min() < 0 or x.max() > most):
                    raise ValueError(f"a token is beyond {self.dtype}")
                f.write(x.astype(self.dtype).tobytes())
                n += len(x)
        return Written(path, first, n)

    def commit(self, messages: list[Written]) -> None:
        fs, at = file_system(self.path)
        mine = {m.path for m in messages if m is not None}
        for f in fs.get_file_info(afs.FileSelector(at, allow_not_found=True)):
            if f.is_file and f.path not in mine and (self.overwrite or f.base_name.startswith("_")):
                fs.delete_file(f.path)
        total = 0
        for m in messages:
            if m is None:
                continue
            if m.n:
                fs.move(m.path, f"{at}/tokens-{m.first:020d}.bin")
            else:
                fs.delete_file(m.path)
            total += m.n
        with fs.open_output_stream(f"{at}/meta.json") as f:
            f.write(json.dumps({"n_tokens": total, "dtype": self.dtype.name}).encode())

    def abort(self, messages: list[Written]) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.path)


class FixedRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, pos long, id long, " + ("value long" if int(self.options.get("width", 1)) == 1 else "values array<float>")

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def records(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """path, pos, id and value or values of the files' records."""
    spark.dataSource.register(FixedRecords)
    return spark.read.format(NAME).options(**{k: str(v) for k, v in options.items()}).load(path)


def write_tokens(stream: DataFrame, path: str, dtype: str = "uint32", parts: int | None = None) -> None:
    """A stream of ids (start, tokens) as files whose names are in the stream's order."""
    spark = stream.sparkSession
    spark.dataSource.register(FixedRecords)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stream.select(F.col("start").cast("long").alias("start"), F.col("tokens").cast("array<long>").alias("tokens"))
    rows.repartitionByRange(parts, "start").sortWithinPartitions("start").write.format(NAME).mode("overwrite").options(dtype=dtype).save(path)
