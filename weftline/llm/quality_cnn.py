"""Quality classifier: a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. In each chunk learned filters over byte
embeddings are max-pooled; a small layer turns the pooled values into one logit, and the logits of a text's chunks,
weighted by their lengths, average to the logit of its probability.

Training takes a bounded sample of the labelled rows that are not held out, each with its whole text: those of the smallest
hashes, at most ``SAMPLE`` of them and ``SAMPLE_CHARS`` characters in all (the first row that would go beyond, and
those behind it, are left out).

Defined cases: null and empty texts are one chunk without bytes; a document with several different labels, a null label or
no label is not learnt from; of rows that share a labelled id the one with the smallest hash of its text is; no labels at all
give 0.5 everywhere; repeated rows get equal scores; windows that tie for a maximum count once, the first; a text of any
length is scored whole, a few chunks at a time; an empty table gives no rows; a kept column that is named as a result gives
way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_utf8, held_out, learnable, map_texts, whole_row

CHUNK, STEP = 256, 224  # bytes in a chunk, and between the starts of two
WIDTH, STRIDE, DIM, FILTERS, HIDDEN = 12, 2, 6, 48, 16
SAMPLE, SAMPLE_CHARS = 4000, 8_000_000  # rows to learn from, and characters of them all
EPOCHS, STEPS, BATCH, RATE = 16, 600, 48, 4e-3  # at least so many passes, and so many steps
DRAWN = 6  # chunks of a document in one pass of the training, drawn anew from its whole text each time
CUT = 0.3
AT_ONCE = 96  # chunks in one matrix product

Model = dict[str, np.ndarray]


def chunks(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text number of each chunk; every text has at least one, and every byte is in one."""
    size = np.diff(off)
    count = np.maximum(1, -(-np.maximum(size - CHUNK, 0) // STEP) + 1)
    doc = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = nth * STEP
    return off[:-1][doc] + start, np.minimum(CHUNK, size[doc] - start), doc


def matrix(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The chunks' bytes, one row each, with zeros behind."""
    at = start[:, None] + np.arange(CHUNK)
    inside = np.arange(CHUNK) < size[:, None]
    return np.where(inside, data[np.minimum(at, len(data) - 1)] if len(data) else 0, 0).astype(np.uint8)


def windows(x: np.ndarray, emb: np.ndarray) -> np.ndarray:
    e = emb[x].reshape(len(x), CHUNK * DIM)
    n = (CHUNK - WIDTH) // STRIDE + 1
    return np.lib.stride_tricks.as_strided(e, (len(x), n, WIDTH * DIM), (e.strides[0], STRIDE * DIM * e.itemsize, e.itemsize)).reshape(-1, WIDTH * DIM)


def filtered(m: Model, x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Value of each filter in each window of each chunk; windows behind a chunk's end never win."""
    n = (CHUNK - WIDTH) // STRIDE + 1
    c = (windows(x, m["emb"]) @ m["conv"]).reshape(len(x), n, FILTERS)
    behind = np.arange(n) * STRIDE >= np.maximum(size, 1)[:, None]
    if behind.any():
        c[behind] = -1e9
    return c


def pooled(m: Model, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of each filter in each chunk, and the window it came from; few chunks at a time, to save memory."""
    pool, at = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.int32)
    for lo in range(0, len(x), AT_ONCE):
        s = slice(lo, lo + AT_ONCE)
        c = filtered(m, x[s], size[s])
        at[s] = c.argmax(1)
        pool[s] = np.take_along_axis(c, at[s][:, None].astype(np.int64), 1)[:, 0]
    return pool, at


def logits(m: Model, pool: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f = np.concatenate([np.maximum(pool + m["bias"], 0), np.minimum(size, CHUNK)[:, None] / CHUNK], 1).astype(np.float32)
    h = np.tanh(f @ m["w1"] + m["b1"])
    return h @ m["w2"] + m["b2"][0], h, f


def score(m: Model | None, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A probability for each text."""
    n = len(off) - 1
    if m is None:
        return np.full(n, 0.5)
    start, size, doc = chunks(off)
    out = np.empty(len(start), np.float64)
    for lo in range(0, len(start), AT_ONCE):
        s = slice(lo, lo + AT_ONCE)
        pool = filtered(m, matrix(data, start[s], size[s]), size[s]).max(1)
        out[s] = logits(m, pool, size[s])[0]
    weight = np.maximum(size, 1).astype(np.float64)
    mean = np.bincount(doc, out * weight, n) / np.bincount(doc, weight, n)
    return 1 / (1 + np.exp(-np.clip(mean, -30, 30)))


def gradients(m: Model, x: np.ndarray, size: np.ndarray, own: np.ndarray, labels: np.ndarray) -> Model:
    """Gradients of the mean log loss of some documents; own: the document of each chunk."""
    pool, at = pooled(m, x, size)
    z, h, f = logits(m, pool, size)
    weight = np.maximum(size, 1) / np.bincount(own, np.maximum(size, 1))[own]
    p = 1 / (1 + np.exp(-np.clip(np.bincount(own, z * weight), -30, 30)))
    dz = (((p - labels) / len(labels))[own] * weight).astype(np.float32)
    dh = dz[:, None] * m["w2"] * (1 - h * h)
    dpool = (dh @ m["w1"].T)[:, :FILTERS] * (f[:, :FILTERS] > 0)
    g = {"b2": dz.sum(keepdims=True), "w2": h.T @ dz, "b1": dh.sum(0), "w1": f.T @ dh, "bias": dpool.sum(0), "conv": np.zeros_like(m["conv"]), "emb": np.zeros((256, DIM))}
    for lo in range(0, len(x), AT_ONCE):  # the bytes under the winning windows, few chunks at a time
        s = slice(lo, lo + AT_ONCE)
        won = x[s][np.arange(len(x[s]))[:, None, None], at[s][:, :, None] * STRIDE + np.arange(WIDTH)]
        e = m["emb"][won].reshape(len(won), FILTERS, -1)
        g["conv"] += np.einsum("nf,nfk->kf", dpool[s], e)
        de = (dpool[s][:, :, None] * m["conv"].T[None]).reshape(-1, DIM)
        g["emb"] += np.stack([np.bincount(won.reshape(-1), de[:, i], 256) for i in range(DIM)], 1)
    return g


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Model | None:
    """Fit the network by gradient steps on the log loss (Adam); None if there is nothing to learn from."""
    if not len(texts):
        return None
    rng = np.random.default_rng(seed)
    m: Model = {
        "emb": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        "conv": rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "w1": rng.normal(0, (FILTERS + 1) ** -0.5, (FILTERS + 1, HIDDEN)).astype(np.float32),
        "b1": np.zeros(HIDDEN, np.float32),
        "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32),
        "b2": np.array([np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))], np.float32),
    }
    n, off, data = len(texts), np.cumsum([0, *map(len, texts)]), np.frombuffer(b"".join(texts), np.uint8)
    del texts
    start, size, doc = chunks(off)
    by_doc = np.searchsorted(doc, np.arange(n + 1))
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    step = 0
    epochs = max(EPOCHS, -(-STEPS * BATCH // n))
    for epoch in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, len(order), BATCH):
            docs = order[lo : lo + BATCH]
            drawn = [np.arange(by_doc[d], by_doc[d + 1]) if by_doc[d + 1] - by_doc[d] <= DRAWN else by_doc[d] + rng.choice(by_doc[d + 1] - by_doc[d], DRAWN, replace=False) for d in docs]
            rows, own = np.concatenate(drawn), np.repeat(np.arange(len(docs)), [len(x) for x in drawn])
            sz = size[rows]
            x = matrix(data, start[rows], sz)
            g = gradients(m, x, sz, own, labels[docs])
            step += 1
            rate = RATE * (1 - epoch / epochs * 0.8)
            for k, v in g.items():
                v = v.astype(np.float32) + (1e-4 * m[k] if k in ("conv", "w1", "w2") else 0)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                m[k] = (m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return m


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, chars: int = SAMPLE_CHARS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, text and label of at most `rows` labelled rows to learn from. Ties of the hash go to the smaller id."""
    one = labels.where(learnable(doc_id) & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo = hi")
    first = one.orderBy(F.xxhash64("id"), "id").limit(rows).select("id", F.col("lo").cast("int").alias("label"))
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("mark")).join(F.broadcast(first), "id")
    light = own.groupBy("id", "label").agg(F.min(F.struct("mark", F.coalesce(F.length("text"), F.lit(0)).alias("size"))).alias("s")).where(F.col("s.size") <= chars)
    order = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = light.withColumn("sum", F.sum("s.size").over(order)).where(F.col("sum") <= chars)  # a window over at most `rows` rows
    picked = F.broadcast(picked.select("id", F.col("s.mark").alias("mark")))
    return own.join(picked, ["id", "mark"]).groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label")).withColumnRenamed("id", doc_id)


def fit(docs: DataFrame, labels: DataFrame, **names: str) -> Model | None:
    got = sample(docs, labels, **names).orderBy(names.get("doc_id", "doc_id")).collect()
    labelled = np.array([r.label for r in got], np.float64)
    texts = [(r.text or "").encode() for r in got]
    del got
    return train(texts, labelled)


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), cut: float = CUT) -> DataFrame:
    """`keep`, score (double, 0 to 1) and predicted (int: score >= cut) of each whole text."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = spread.value

        def run(texts: pa.Array) -> list[pa.Array]:
            s = np.round(score(m, *flat_utf8(texts)), 6)
            return [pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32))]

        return run

    return map_texts(docs, text_col, list(keep), [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make)


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    got = scored(docs, fit(docs, labels))
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def kept(docs: DataFrame, model: Model | None, cut: float = CUT) -> DataFrame:
    """The documents, with all their columns, that the classifier doesn't reject. Defined cases: as above; columns of any names stay."""
    packed = docs.select("text", whole_row(docs).alias("row"))
    return scored(packed, model, keep=("row",), cut=cut).where("predicted = 1").select("row.*")
