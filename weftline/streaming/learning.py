"""Predict, then learn: each chunk of a document is scored with what was learnt from the chunks before it, and then learnt from.

Three models are mixed: a uniform one, a unigram and a bigram one, both with additive smoothing over the words of the
document's complete chunks so far. After a complete chunk the mixture's weights move towards the share that each model
had in its predictions. Nothing of a chunk is known while it is scored, whichever way a document is cut into parts.

``learnt`` is Structured Streaming: the counts, the weights and the open chunk are a document's state, so documents may
arrive in parts over many rounds, and a run that ends goes on from its checkpoint. ``causal_bigram`` gives the bigram's part
for whole tables: a document's words are numbered and its counts made in one task, so what is shuffled is documents, not words.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHUNK, ALPHA, VOCAB = 256, 0.1, 4096
RATE = 0.05  # fixed value: how far weights move after a chunk
RESULT = "doc_id long, part long, chunk long, n long, nll double, nll_unigram double, nll_bigram double, w_uniform double, w_unigram double, w_bigram double"
STATE = "part long, seen long, last string, known binary, mix array<double>, share array<double>"
WORDS = 1 << 31  # more than a document has different words


class Learner:
    """What is known of one document: its words by number, how often which follows which in complete chunks, and the open chunk's cases.

    In a state these are one compressed value, so it is a few bytes for each word and no object for each.
    """

    def __init__(self, state: tuple | None):
        self.part, self.seen, self.last, known, mix, share = state or (-1, 0, None, None, [0.0] * 3, [0.0] * 3)
        self.mix, self.share, self.ids = np.array(mix), np.array(share), {}
        self.pairs, self.times, self.open = (np.zeros(0, np.int64) for _ in range(3))
        if known is not None:
            b = zlib.decompress(known)
            text, pairs, opened = np.frombuffer(b, np.int64, 3)
            self.ids = {w: i for i, w in enumerate(json.loads(b[24 : 24 + text]))}
            rest = np.frombuffer(b[24 + text :], np.int64)
            self.pairs, self.times, self.open = np.cumsum(rest[:pairs]), rest[pairs : 2 * pairs], rest[2 * pairs :]

    def state(self) -> tuple:
        text = json.dumps(list(self.ids)).encode()
        head = np.array([len(text), len(self.pairs), len(self.open)], np.int64)
        parts = [head.tobytes(), text, np.diff(self.pairs, prepend=0).tobytes(), self.times.tobytes(), self.open.tobytes()]
        return self.part, self.seen, self.last, zlib.compress(b"".join(parts), 1), self.mix.tolist(), self.share.tolist()

    def weights(self) -> np.ndarray:
        e = np.exp(self.mix - self.mix.max())
        return e / e.sum()

    def read(self, parts: list[tuple[int, list[str]]], size: int) -> list[list]:
        """part, chunk, n, losses and weights of each part's share of each chunk."""
        words = [w for _, p in parts for w in p]
        if not words:
            return []
        t = np.array([self.ids.setdefault(w, len(self.ids)) for w in words], np.int64)
        part = np.repeat([k for k, _ in parts], [len(p) for _, p in parts])
        if self.last is None:
            x, y, part = t[:-1], t[1:], part[1:]
        else:
            x, y = np.r_[self.ids[self.last], t[:-1]], t
        self.last = words[-1]
        old = len(self.open)
        case = np.r_[self.open, x * WORDS + y]
        chunk = (self.seen - old + np.arange(len(case))) // size
        x, y = case // WORDS, case % WORDS

        # counts of the complete chunks before this call, and of those before each case's own in it
        known = [np.bincount(k, self.times, minlength=len(self.ids)) for k in (self.pairs // WORDS, self.pairs % WORDS)]
        before, after, both = known[0][x], known[1][y], np.zeros(len(case))
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, case), len(self.pairs) - 1)
            both = np.where(self.pairs[at] == case, self.times[at], 0)
        if len(chunk) and chunk[-1] > chunk[0]:
            before, after, both = before + _known(x, chunk), after + _known(y, chunk), both + _known(case, chunk)
        p = np.stack([np.full(len(case), 1 / VOCAB), (after + ALPHA) / (chunk * size + ALPHA * VOCAB), (both + ALPHA) / (before + ALPHA * VOCAB)])[:, old:]
        loss, own = -np.log(p[1:]), chunk[old:]

        out, w = [], self.weights()
        turn = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (part[1:] != part[:-1])]) if len(own) else []
        for lo, hi in zip(turn, [*turn[1:], len(own)][: len(turn)], strict=True):
            q = p[:, lo:hi]
            mixed = w @ q
            out.append([int(part[lo]), int(own[lo]), int(hi - lo), -np.log(mixed).sum(), *loss[:, lo:hi].sum(1), *w])
            self.share = self.share + w * (q / mixed).sum(1)
            self.seen += int(hi - lo)
            if self.seen % size == 0:
                self.mix = self.mix + RATE * (self.share / size - w)
                self.share, w = np.zeros(3), self.weights()
        whole = len(case) // size * size
        if whole:
            self.pairs, at = np.unique(np.r_[self.pairs, case[:whole]], return_inverse=True)
            self.times = np.bincount(at, np.r_[self.times, np.ones(whole, np.int64)]).astype(np.int64)
        self.open = case[whole:]
        return out


def learnt(parts: DataFrame, size: int = CHUNK) -> DataFrame:
    """Losses and the weights used, for each chunk of each part that arrives; parts: doc_id, part, tokens.

    A document's parts are numbered and come in that order, of one round in any; a part that is not behind the last one
    is an old one sent again and is left out, so sources that repeat rows change nothing. A chunk that several parts share gives a row for each.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Learner(state.get if state.exists else None)
        rows = sorted(((int(p), i, j, t) for i, f in enumerate(frames) for j, (p, t) in enumerate(zip(f["part"], f["tokens"], strict=True))), key=lambda r: r[:3])
        fresh = []
        for part, _, _, words in rows:
            if part > own.part:
                fresh.append((part, list(words)))
                own.part = part
        out = own.read(fresh, size)
        state.update(own.state())
        names = [c.split()[0] for c in RESULT.split(", ")]
        yield pd.DataFrame({n: c for n, c in zip(names, [[key[0]] * len(out), *zip(*out, strict=True)], strict=True)} if out else {n: [] for n in names})

    return parts.groupBy("doc_id").applyInPandasWithState(run, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)


def by_document(rows: DataFrame) -> DataFrame:
    """doc_id, n and losses in all, and the bigram's weight in the last chunk."""
    total = [F.round(F.sum(c), 4).alias(c) for c in ("nll", "nll_unigram", "nll_bigram")]
    return rows.groupBy("doc_id").agg(F.sum("n").alias("n"), *total, F.round(F.max_by("w_bigram", "chunk"), 9).alias("w_bigram"))


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in a sorted table of keys."""
    return np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.zeros(0, np.int64)


def _known(case: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """How many cases of the same number are in chunks before each case's own; chunks grow."""
    order = np.lexsort((chunk, case))
    c, k = case[order], chunk[order]

    def first(keys: np.ndarray) -> np.ndarray:
        mark = np.zeros(len(c), np.int64)
        mark[_runs(keys)] = _runs(keys)
        return np.maximum.accumulate(mark)

    out = np.empty(len(c), np.int64)
    out[order] = first(np.c_[c, k]) - first(c[:, None])
    return out


def causal_bigram(s: DataFrame, size: int = CHUNK, alpha: float = ALPHA, vocab: int = VOCAB) -> DataFrame:
    """doc_id, chunk, n, nll of the bigram model that knows the document's chunks before; s: doc_id, tokens.

    A document is one row, so its counts are made where it is: rows that share an id are brought together, as one string
    each, and nothing smaller than a document is shuffled.
    """
    parts = s.where(F.size("tokens") > 1).groupBy("doc_id").agg(F.collect_list(F.to_json("tokens")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                x, y, chunk = [], [], []
                ids: dict[str, int] = {}
                for part in batch.column(1)[row].as_py():
                    t = np.array([ids.setdefault(w, len(ids)) for w in json.loads(part)], np.int64)
                    x.append(t[:-1])
                    y.append(t[1:])
                    chunk.append(np.arange(len(t) - 1) // size)
                x, y, chunk = (np.concatenate(a) for a in (x, y, chunk))
                loss = -np.log((_known(x * len(ids) + y, chunk) + alpha) / (_known(x, chunk) + alpha * vocab))
                n = np.bincount(chunk)
                out.append((np.full(len(n), row), np.arange(len(n)), n, np.bincount(chunk, loss)))
            if out:
                row, chunk, n, nll = (np.concatenate(a) for a in zip(*out, strict=True))
                cols = [batch.column(0).take(pa.array(row)), pa.array(chunk), pa.array(n), pa.array(nll)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "chunk", "n", "nll"])

    return parts.mapInArrow(run, "doc_id long, chunk long, n long, nll double").withColumn("nll", F.round("nll", 4))
