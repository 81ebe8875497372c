"""Document fingerprints by one-permutation MinHash.

A text is the set of its five-word shingles (words: runs of letters, digits and ``_`` in lower case; a text of one to four
words is one shingle). Each shingle is hashed once: the hash's upper bits name one of ``BINS`` bins, the rest is its value
there, and a bin keeps its smallest value. An empty bin takes the value of a full one by optimal densification: bin i goes
through the bins in an order of its own, the same for every text, and takes the first full one. Of each value, hashed with
its bin's number, ``BITS`` low bits are stored, packed. Two bins agree if they hold the same value, and else by chance in one of
2^BITS cases; likeness takes that out: (share that agrees - 2^-BITS) / (1 - 2^-BITS), from 0 to 1. It estimates the
Jaccard similarity of the shingle sets, with a standard error of about 0.03 at 256 bins.

``against_next`` walks the documents in the order of descending id. They are dealt by ranges of the order and sorted once;
each task holds a batch and the last document of the batch before. The first and the last document of each range are put
together afterwards: so many rows as there are ranges. The texts are shuffled once; what is written is fingerprints.

Defined cases: a null text is an empty one; a text without a word has the empty fingerprint, which is like another empty one
(1) and unlike all others (0); rows without an id come last, and rows that share an id are ordered by their texts' hashes;
a row that is alone follows itself; repeats are rows of their own; texts of any length are taken whole, a long one in a
batch of its own; an empty table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, map_texts, sub_batches
from .jaccard import WORDS, shingles

BINS, BITS = 256, 4
ROWS = 2048  # texts whose bins are held at a time
TRIES = 8  # places that all empty bins look at together, before each text's rest is looked up at once
EMPTY = np.uint64(2**64 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def orders(bins: int) -> np.ndarray:
    """For each bin the place of every bin in its own order."""
    key = mixed(np.arange(bins * bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)).reshape(bins, bins)
    return np.argsort(np.argsort(key, axis=1, kind="stable"), axis=1)


class Sketcher:
    """Packed fingerprints of texts; one for each task."""

    def __init__(self, bins: int = BINS, bits: int = BITS, words: int = WORDS):
        if bins & (bins - 1) or bins * bits % 8:
            raise ValueError("bins must be a power of two that fills whole bytes")
        self.bins, self.bits, self.words = bins, bits, words
        self.place = orders(bins)
        self.order = np.argsort(self.place, axis=1)

    def binned(self, h: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The smallest value of each bin of each set, EMPTY where there is none."""
        low = np.uint64(64 - self.bins.bit_length() + 1)
        out = np.full((len(off) - 1) * self.bins, EMPTY)
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        np.minimum.at(out, row * self.bins + (h >> low).astype(np.int64), h & ((np.uint64(1) << low) - np.uint64(1)))
        return out.reshape(-1, self.bins)

    def densified(self, v: np.ndarray) -> np.ndarray:
        """Empty bins filled; rows that are empty throughout stay so."""
        out, full = v.copy(), v != EMPTY
        r, i = np.nonzero(~full & full.any(1)[:, None])
        for t in range(TRIES):
            j = self.order[i, t]
            hit = full[r, j]
            out[r[hit], i[hit]] = v[r[hit], j[hit]]
            r, i = r[~hit], i[~hit]
        for lo, hi in zip(*_runs(r), strict=True):
            have = np.flatnonzero(full[r[lo]])
            out[r[lo], i[lo:hi]] = v[r[lo], have[self.place[i[lo:hi]][:, have].argmin(1)]]
        return out

    def packed(self, v: np.ndarray) -> np.ndarray:
        own = mixed(v + np.arange(self.bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        bits = (own[:, :, None] >> np.arange(self.bits, dtype=np.uint64)) & np.uint64(1)
        return np.packbits(bits.astype(np.uint8).reshape(len(v), -1), axis=1)

    def sketch(self, texts: pa.Array) -> list[bytes]:
        """A fingerprint of each text; b'' for one without a word."""
        h, off = shingles(texts, self.words)
        out: list[bytes] = []
        for lo in range(0, len(texts), ROWS):
            ends = off[lo : lo + ROWS + 1]
            has = np.diff(ends) > 0
            codes = self.packed(self.densified(self.binned(h[ends[0] : ends[-1]], ends - ends[0])))
            out += [c.tobytes() if k else b"" for c, k in zip(codes, has, strict=True)]
        return out

    def likeness(self, a: list[bytes], b: list[bytes]) -> np.ndarray:
        """Estimated similarity of pairs of fingerprints, from 0 to 1."""
        size = self.bins * self.bits // 8
        whole = np.array([len(x) == size and len(y) == size for x, y in zip(a, b, strict=True)], bool)
        out = np.array([float(x == y) for x, y in zip(a, b, strict=True)])
        if whole.any():
            pair = [np.frombuffer(b"".join(x for x, k in zip(side, whole, strict=True) if k), np.uint8).reshape(-1, size) for side in (a, b)]
            differ = np.unpackbits(pair[0] ^ pair[1], axis=1).reshape(-1, self.bins, self.bits).any(2)
            chance = 2.0**-self.bits
            out[whole] = np.clip((1 - differ.mean(1) - chance) / (1 - chance), 0, 1)
        return out


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Begins and ends of the runs of equal neighbours."""
    if not len(x):
        return [], []
    cut = (np.flatnonzero(x[1:] != x[:-1]) + 1).tolist()
    return [0, *cut], [*cut, len(x)]


def fingerprinted(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), bins: int = BINS, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """`keep` and fingerprint (packed, as bytes) of each row, without a shuffle."""

    def make():
        s = Sketcher(bins, bits, words)
        return lambda texts: [pa.array(s.sketch(texts), pa.binary())]

    return map_texts(docs, text_col, list(keep), [T.StructField("fingerprint", T.BinaryType())], make)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
DONE, FIRST, LAST = 0, 1, 2


def edited(text: str, following: str) -> str:
    """The text with its last third of code points replaced by as many of the following text's first, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def compared(s: Sketcher, ids: list, texts: list[str], prints: list[bytes], next_texts: list[str], next_prints: list[bytes]) -> list[pa.Array]:
    """The result's columns for documents and those that follow them."""
    new = [edited(t, x) for t, x in zip(texts, next_texts, strict=True)]
    codes = s.sketch(pa.array(new, pa.string()))
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
        pa.array([p.hex() for p in prints], pa.string()),
        pa.array([p.hex() for p in codes], pa.string()),
        pa.array(s.likeness(prints, codes), pa.float64()),
        pa.array(s.likeness(prints, next_prints), pa.float64()),
    ]


def walked(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (part, doc_id, text): results of all but the last one, and the texts of the first and the last."""
    names = [*[f.split()[0] for f in RESULT.split(", ")], "kind", "part", "text"]
    s, held, part = make(), None, None

    def end(kind: int) -> pa.RecordBatch:
        ids, text, code = held
        cols = [pa.array([ids], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([code.hex()]), pa.nulls(1, pa.string()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64())]
        return pa.RecordBatch.from_arrays([*cols, pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([text])], names=names)

    for batch in batches:
        for rows in sub_batches(batch, 2):
            texts = rows.column(2).fill_null("")
            codes, ids, texts = s.sketch(texts), rows.column(1).to_pylist(), texts.to_pylist()
            if held is None:
                part, held = rows.column(0)[0].as_py(), (ids[0], texts[0], codes[0])
                yield end(FIRST)
            else:
                ids, texts, codes = [held[0], *ids], [held[1], *texts], [held[2], *codes]
            n = len(ids) - 1
            if n:
                cols = compared(s, ids[:-1], texts[:-1], codes[:-1], texts[1:], codes[1:])
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(n, DONE, np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=names)
            held = ids[-1], texts[-1], codes[-1]
            pa.default_memory_pool().release_unused()
    if held is not None:
        yield end(LAST)


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """Each document's fingerprint beside its edited text's, and their likeness, and that to the next document's."""
    spark = docs.sparkSession
    make = lambda: Sketcher(bins, bits, words)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    order = [F.desc_nulls_last("doc_id"), "h", "row"]  # the row's number parts equal rows, so that many of them are several ranges
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    got = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(lambda b: walked(b, make), f"{RESULT}, kind int, part int, text string")
    held = checkpointed(got)  # ranges are drawn once; what follows reads what they gave

    ends = held.where(F.col("kind") != DONE).select("kind", "part", "doc_id", "text", "fingerprint")  # two rows for each range
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one number for each range
    ring = ends.where(F.col("kind") == FIRST).select("part").select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(every)).alias("next"))
    heads = ends.where(F.col("kind") == FIRST).select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    last = ends.where(F.col("kind") == LAST).join(ring, "part").join(heads, "next").select("doc_id", "text", "fingerprint", "next_text", "next_print")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = make()
        for batch in batches:
            for b in sub_batches(batch, 1):
                ids, texts, codes, next_texts, next_codes = (c.to_pylist() for c in b.columns)
                cols = compared(s, ids, texts, [bytes.fromhex(c) for c in codes], next_texts, [bytes.fromhex(c) for c in next_codes])
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in RESULT.split(", ")])

    return held.where(F.col("kind") == DONE).drop("kind", "part", "text").unionByName(last.mapInArrow(close, RESULT))


def op12(docs: DataFrame) -> DataFrame:
    return against_next(docs)
