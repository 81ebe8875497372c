"""Counts of tuples of words, shuffled as one packed row of each chunk for each part.

A task counts a chunk's tuples as numbers and deals the different ones into parts; what belongs to a part is one compressed row.
The most frequent words, whose number is bounded, have the same number in all tasks; a row spells only its other words. So
what is shuffled is a few bytes for each tuple, not its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens, vocab
from .ranking import _coded, _numbers, _ordered, _pack, _planes, _unpack

TOP = 1 << 16  # words that have the same number in all tasks
CHUNK = 2_000_000  # tokens that are counted together; three numbers of its words fit 63 bits
ROWS = "part int, words binary, ids binary, times binary"

Combine = Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def frequent(s: DataFrame, most: int = TOP) -> list[str]:
    """The most frequent words, ties by bytes."""
    return [r.word for r in vocab.frequencies(s).orderBy(F.desc("freq"), "word").limit(most).select("word").collect()]


def spelled(words: pa.Array) -> bytes:
    return _pack(tokens.MARK.join(words.to_pylist()).encode())


def words_of(b: bytes) -> pa.Array:
    text = _unpack(b).decode()
    return pc.split_pattern(pa.array([text] if text else [], pa.string()), tokens.MARK).flatten()


def _codes(words: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) for w in words.to_pylist()], np.int64)


def dealt(s: DataFrame, before: int, combine: Combine, known: list[str], chunk: int = CHUNK) -> DataFrame:
    """Packed rows of a led stream's counted tuples.

    combine gets a chunk's words as numbers, for each place how many tokens from its document's lead on are before it (-1 for
    places that are not to be counted), and the CRC-32 of each word by number. Frequent words have their place among `known` as
    number, the others greater ones in the order of their bytes. It gives parts, tuples (a row for each, each once) and counts.
    """
    shared = s.sparkSession.sparkContext.broadcast(known)

    def chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
        size, low = np.diff(batch.column(0).offsets.to_numpy()), batch.column(1).to_numpy()
        words = batch.column(0).flatten()
        depth = np.arange(len(words)) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
        own = depth >= np.repeat(low, size)
        for lo in range(0, len(words), chunk):
            at = max(0, lo - before)  # places before the chunk's own, which its tuples may hold
            hi = min(len(words), lo + chunk)
            mine = own[at:hi].copy()
            mine[: lo - at] = False
            yield words.slice(at, hi - at), np.where(mine, depth[at:hi], -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = pa.array(shared.value, pa.string())
        first, n_top = _codes(top), len(top)
        for batch in batches:
            for words, depth in chunks(batch):
                coded = words.dictionary_encode()
                at = pc.index_in(coded.dictionary, top)
                rare = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
                rare = rare[pc.sort_indices(coded.dictionary.take(pa.array(rare))).to_numpy()]
                names = coded.dictionary.take(pa.array(rare))
                number = at.fill_null(0).to_numpy().astype(np.int64)
                number[rare] = n_top + np.arange(len(rare))
                for part, ids, times in combine(number[coded.indices.to_numpy()], depth, np.r_[first, _codes(names)]):
                    order = np.argsort(part, kind="stable")
                    part = part[order]
                    begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
                    rows = []
                    for lo, hi in zip(begin, np.r_[begin[1:], len(part)], strict=True):
                        x = ids[order[lo:hi]]
                        own = np.unique(x[x >= n_top])
                        x = np.where(x >= n_top, n_top + np.searchsorted(own, x), x)
                        rows.append((part[lo], spelled(names.take(pa.array(own - n_top))), _pack(_planes(x)), _pack(_planes(times[order[lo:hi], None]))))
                    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=["part", "words", "ids", "times"])

    rows = tokens.with_lead(s.where("n > 0"), before).select("all", (F.size("all") - F.col("n")).cast("int").alias("low"))
    return rows.mapInArrow(run, ROWS)


def merged(got: pa.Table, wide: int, known: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A part's different tuples in the order of their numbers, their counts, and the words by number."""
    lists = [words_of(b.as_py()) for b in got.column("words")]
    code, rare = _coded(pa.concat_arrays(lists)) if lists else (np.zeros(0, np.int64), pa.array([], pa.string()))
    ids, lo, n = [], 0, len(known)
    for words, b in zip(lists, got.column("ids"), strict=True):
        number = np.r_[np.arange(n), n + code[lo : lo + len(words)]].astype(np.uint32)
        ids.append(number[_numbers(_unpack(b.as_py()), wide)])
        lo += len(words)
    ids = np.concatenate(ids) if ids else np.zeros((0, wide), np.uint32)
    times = np.concatenate([_numbers(_unpack(b.as_py()), 1)[:, 0] for b in got.column("times")]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    order, new = _ordered(lambda j: ids[:, j], wide, n + len(rare))
    first = np.flatnonzero(new)
    return ids[order[first]], np.add.reduceat(times[order], first) if len(first) else times, pa.concat_arrays([pa.array(known, pa.string()), rare])
