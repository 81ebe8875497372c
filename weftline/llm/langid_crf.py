"""Language identification: a linear-chain conditional random field over the words of code-switched text.

Each word has features (the word in a lexicon, its first and last letters, its letter n-grams), whose learned weights
give it a potential for each language; learned transitions tie neighbours. Forward-backward gives each word's marginal
distribution. A text's language is the one with the largest mean marginal (ties: the smaller name), its score that mean.

Words are maximal runs of letters, in lower case. Training takes a bounded sample of learnable rows, each with its whole
text: of each language the rows of the smallest hashes that fit into ``ROWS`` rows and its part of ``LETTERS`` characters
(the first row that would go beyond, and those behind it, are left out); of more than ``LANGUAGES`` languages the most frequent are learned. Pieces of several
languages are spliced into one sequence, as in code-switched text, so that transitions are learned.

Defined cases: a text that is null or has no letter is `und` with score 0; without anything to learn from all texts are
`und`; repeated rows get equal rows; a text of any length is labelled whole, all its words as one chain; an empty table
gives no rows; a kept column that is named as a result gives way to it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, learnable, map_texts

ROWS, LETTERS, LANGUAGES = 400, 2_000_000, 64  # bounds of what is learned from
BITS = 17  # of a feature's hash
STEPS = 64  # words in a training sequence; also rows of the table that forward-backward walks in large batches
EPOCHS, BATCH, RATE = 6, 64, 0.05
LEXICON = 20_000  # most frequent words of the sample that are features of their own
SWITCH = 0.35  # part of the training sequences that hold several languages
UND = "und"
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number among them of each word of all texts end to end, and the texts' n + 1 offsets."""
    clean = pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}]+", " ")
    parts = pc.split_pattern(pc.utf8_trim(clean, " "), " ")
    off = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.flatten()
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    off = off - off[0]
    if empty.any():  # texts without a letter
        off = np.r_[0, np.cumsum(~empty)][off]
        ids = ids[~empty]
    return coded.dictionary, ids, off


def features(vocab: list[str], lexicon: dict[str, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, end to end, and the n + 1 offsets.

    Of each kind: the word itself if in the lexicon; first 1 to 3 and last 1 to 3 letters; letter n-grams of 1 to 4
    with a mark on either side.
    """
    n = len(vocab)
    joined = "".join([f"\x02{w}\x03" for w in vocab])
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in vocab), np.int64, n)
    ends = np.cumsum(size)
    own = np.repeat(np.arange(n), size)
    begin = (ends - size)[own]
    at = np.arange(len(codes))
    owner, value = [], []
    h = np.zeros(len(codes), np.uint64)
    for k in range(1, 5):
        m = len(codes) - k + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint64(1_000_003) + codes[k - 1 : k - 1 + m]) & np.uint64((1 << 62) - 1)
        fits = at[:m] + k <= ends[own[:m]]
        mixed = (h + np.uint64(k)) * _MUL
        owner.append(own[:m][fits])
        value.append(mixed[fits] >> np.uint64(64 - BITS))
        if k > 1:  # with its mark: the first or last k - 1 letters
            for edge in (at[:m] == begin[:m], at[:m] + k == ends[own[:m]]):
                edge = edge & fits
                owner.append(own[:m][edge])
                value.append((mixed[edge] * _MUL + np.uint64(k)) >> np.uint64(64 - BITS))
    known = np.fromiter(((zlib.crc32(w.encode()) if lexicon is None or w in lexicon else -1) for w in vocab), np.int64, n)
    there = np.flatnonzero(known >= 0)
    owner.append(there)
    value.append(((known[there].astype(np.uint64) + np.uint64(77)) * _MUL) >> np.uint64(64 - BITS))
    owner, value = np.concatenate(owner), np.concatenate(value).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return value[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=n))]


def potentials(weights: np.ndarray, feats: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each word's log potential for each label: the mean of its features' weights times 8."""
    out = np.empty((len(off) - 1, weights.shape[1]), np.float64)
    for j in range(weights.shape[1]):
        out[:, j] = np.add.reduceat(weights[feats, j], off[:-1])
    return out * (8 / np.diff(off))[:, None]


def marginals(emit: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray, steps: int) -> np.ndarray:
    """Forward-backward over many chains end to end.

    emit: positive potentials of N words; first: where a chain begins; start, trans: positive. The words are laid out
    as columns of `steps` words: transfer matrices of all columns are multiplied up at the same time, then the columns
    are chained, then both passes run inside all columns at once. Exact, whatever the chains' lengths.
    """
    n, labels = emit.shape
    cols = -(-n // steps)
    pad = cols * steps - n
    e = np.concatenate([emit, np.ones((pad, labels))]).reshape(cols, steps, labels).transpose(1, 0, 2).copy()
    f = np.concatenate([first, np.ones(pad, bool)]).reshape(cols, steps).T.copy()

    def forward(a: np.ndarray, t: int) -> np.ndarray:
        b = a @ trans
        if f[t].any():
            w = f[t]
            b[w] = a[w].sum(-1, keepdims=True) * start
        b *= e[t][:, None, :] if b.ndim == 3 else e[t]
        return b / b.sum(-1, keepdims=True).max(-2, keepdims=True) if b.ndim == 3 else b / b.sum(-1, keepdims=True)

    across = np.broadcast_to(np.eye(labels), (cols, labels, labels)).copy()
    for t in range(steps):
        across = forward(across, t)
    into = np.empty((cols, labels))
    v = np.full(labels, 1 / labels)
    for c in range(cols):
        into[c] = v
        v = v @ across[c]
        v /= v.sum()
    out_of = np.empty((cols, labels))
    v = np.ones(labels)
    for c in range(cols - 1, -1, -1):
        out_of[c] = v
        v = across[c] @ v
        v /= v.sum()
    alpha = np.empty((steps, cols, labels))
    a = into
    for t in range(steps):
        a = forward(a, t)
        alpha[t] = a
    beta = out_of
    for t in range(steps - 1, -1, -1):
        alpha[t] *= beta
        x = e[t] * beta
        b = x @ trans.T
        w = f[t]
        if w.any():
            b[w] = (x[w] @ start)[:, None]
        beta = b / b.sum(-1, keepdims=True)
    gamma = alpha.transpose(1, 0, 2).reshape(-1, labels)[:n]
    return gamma / gamma.sum(1, keepdims=True)


class Model:
    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        self.labels, self.lexicon = labels, lexicon
        n = len(labels)
        self.weights = np.zeros((1 << BITS, n), np.float32)
        self.trans, self.start = np.where(np.eye(n) > 0, 1.0, -1.0), np.zeros(n)

    def label(self, vocab: list[str], ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Marginals of each word of each text."""
        if not len(ids):
            return np.zeros((0, len(self.labels)))
        pot = potentials(self.weights, *features(vocab, self.lexicon))
        pot = np.exp(np.clip(pot - pot.max(1, keepdims=True), -50, 0))
        first = np.zeros(len(ids) + 1, bool)
        first[off] = True
        return marginals(pot[ids], first[:-1], np.exp(self.start), np.exp(self.trans), max(16, min(512, int(len(ids) ** 0.5))))


def sequences(vocab_of: list[list[int]], tags: np.ndarray, labels: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Word numbers and labels of training sequences of STEPS words; some are spliced from several texts."""
    out = []
    for ws, tag in zip(vocab_of, tags, strict=True):
        for lo in range(0, len(ws), STEPS):
            out.append((np.array(ws[lo : lo + STEPS]), np.full(len(ws[lo : lo + STEPS]), tag)))
    pieces = [x for x in out if len(x[0])]
    for _ in range(int(len(pieces) * SWITCH)):
        w, y, room = [], [], STEPS
        while room > 0:
            a, b = pieces[rng.integers(len(pieces))]
            k = int(min(room, len(a), rng.integers(3, 25)))
            at = rng.integers(len(a) - k + 1)
            w.append(a[at : at + k])
            y.append(b[at : at + k])
            room -= k
        pieces.append((np.concatenate(w), np.concatenate(y)))
    return pieces


def train(texts: list[str], tags: list[str], seed: int = 3) -> Model | None:
    """Maximise the conditional likelihood of the word labels by gradient steps (AdaGrad); None without a word."""
    vocab, ids, off = words(pa.array(texts, pa.string()))
    if not len(ids):
        return None
    rng = np.random.default_rng(seed)
    vocab = vocab.to_pylist()
    labels = sorted(set(tags))
    top = np.argsort(-np.bincount(ids, minlength=len(vocab)), kind="stable")[:LEXICON]
    m = Model(labels, {vocab[i]: 1 for i in top})
    n = len(labels)
    feats, at = features(vocab, m.lexicon)
    pieces = sequences([ids[lo:hi].tolist() for lo, hi in zip(off[:-1], off[1:], strict=True)], np.array([labels.index(t) for t in tags]), n, rng)
    seen = np.full(m.weights.shape, 1e-6, np.float32)
    seen_t, seen_s = np.full((n, n), 1e-6), np.full(n, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(pieces))
        for lo in range(0, len(order), BATCH):
            own = [pieces[i] for i in order[lo : lo + BATCH]]
            w, y = (np.concatenate(x) for x in zip(*own, strict=True))
            size = np.array([len(x[0]) for x in own])
            first = np.zeros(len(w), bool)
            first[np.cumsum(size) - size] = True
            uniq, inv = np.unique(w, return_inverse=True)
            count = (at[uniq + 1] - at[uniq]).astype(np.int64)
            ends = np.cumsum(count)
            rows = np.arange(ends[-1]) + np.repeat(at[uniq] - (ends - count), count)
            f = feats[rows]
            pot = potentials(m.weights, f, np.r_[0, ends])
            e = np.exp(np.clip(pot - pot.max(1, keepdims=True), -50, 0))[inv]
            gamma, pairs = _expected(e, first, np.exp(m.start), np.exp(m.trans))
            gap = gamma.copy()
            gap[np.arange(len(w)), y] -= 1
            g_word = np.stack([np.bincount(inv, gap[:, j], len(uniq)) for j in range(n)], 1) * (8 / count)[:, None] / len(w)
            spread = np.repeat(g_word, count, axis=0)
            cells, cell = np.unique(f, return_inverse=True)
            g = np.stack([np.bincount(cell, spread[:, j], len(cells)) for j in range(n)], 1)
            seen[cells] += g * g
            m.weights[cells] -= (RATE * g / np.sqrt(seen[cells])).astype(np.float32)
            follow = np.flatnonzero(~first)
            real = np.zeros((n, n))
            np.add.at(real, (y[follow - 1], y[follow]), 1)
            g = (pairs - real) / max(1, len(follow))
            seen_t += g * g
            m.trans -= RATE * 2 * g / np.sqrt(seen_t)
            g = (gamma[first].sum(0) - np.bincount(y[first], minlength=n)) / first.sum()
            seen_s += g * g
            m.start -= RATE * g / np.sqrt(seen_s)
    return m


def _expected(e: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected transition counts of chains of at most STEPS words."""
    at = np.flatnonzero(first)
    size = np.diff(np.r_[at, len(e)])
    n, steps, labels = len(at), int(size.max()), e.shape[1]
    place = at[:, None] + np.minimum(np.arange(steps), size[:, None] - 1)
    inside = np.arange(steps) < size[:, None]
    x = e[place]
    alpha, beta = np.empty((steps, n, labels)), np.ones((steps, n, labels))
    a = start * x[:, 0]
    for t in range(steps):
        if t:
            a = np.where(inside[:, t, None], (a @ trans) * x[:, t], a)
        a = a / a.sum(1, keepdims=True)
        alpha[t] = a
    pairs = np.zeros((labels, labels))
    for t in range(steps - 1, 0, -1):
        y = x[:, t] * beta[t]
        b = np.where(inside[:, t, None], y @ trans.T, 1.0)
        beta[t - 1] = b / b.sum(1, keepdims=True)
        k = inside[:, t]
        p = alpha[t - 1][k][:, :, None] * trans * y[k][:, None, :]
        pairs += (p / p.sum((1, 2), keepdims=True)).sum(0)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    return gamma.transpose(1, 0, 2)[inside], pairs


def sample(docs: DataFrame, rows: int = ROWS, letters: int = LETTERS, languages: int = LANGUAGES, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """text, lang, h and doc_id of the rows to learn from: at most `rows` of a language and `letters` characters in all."""
    own = docs.where(learnable(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("string").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    sizes = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.count("*").alias("all"))))
    # a slice of the hash's range that holds about three times the rows asked for; all rows if there are fewer
    h = F.xxhash64("doc_id")
    share = F.lit(3.0 * rows) / F.col("n")
    near = own.join(F.broadcast(sizes.select("lang", "n", F.floor(F.lit(letters) / F.col("all")).alias("room"))), "lang").where(F.shiftrightunsigned(h, 11) / F.lit(2.0**53) < share)
    light = near.select("doc_id", "lang", h.alias("h"), F.xxhash64("text").alias("mark"), F.length("text").alias("size"), "room").where("size <= room")
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "mark")
    picked = light.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows)
    picked = picked.withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("sum <= room")
    picked = F.broadcast(picked.select("doc_id", "lang", "mark", "h").distinct())  # at most `rows` for each of `languages`
    return near.withColumn("mark", F.xxhash64("text")).join(picked, ["doc_id", "lang", "mark"]).dropDuplicates(["doc_id", "lang", "mark"]).select("text", "lang", picked["h"], "doc_id")


def fit(docs: DataFrame, **names: str) -> Model | None:
    got = sorted(sample(docs, **names).collect(), key=lambda r: (r.h, r.doc_id, r.text))
    return train([r.text for r in got], [r.lang for r in got]) if got else None


FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("n_switches", T.LongType()),
]
SPANS = [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("n_words", T.LongType())])))]


def identified(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_spans: bool = False) -> DataFrame:
    """`keep`, lang_pred, score, n_words and n_switches (neighbours whose likeliest labels differ) of each whole text.

    with_spans adds the runs of words of one language, in order.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = spread.value
        names = np.array(m.labels if m else [UND], object)

        def run(texts: pa.Array) -> list[pa.Array]:
            vocab, ids, off = words(texts)
            size = np.diff(off)
            n = len(size)
            has = size > 0
            pred, score, switches, spans = np.full(n, UND, object), np.zeros(n), np.zeros(n, np.int64), [[] for _ in range(n)]
            if m and has.any():
                gamma = m.label(vocab.to_pylist(), ids, off)
                mean = np.add.reduceat(gamma, off[:-1][has], axis=0) / size[has][:, None]
                best = np.round(mean, 9).argmax(1)
                pred[has], score[has] = names[best], np.clip(mean[np.arange(len(best)), best], 0, 1)
                top = gamma.argmax(1)
                turn = np.r_[False, top[1:] != top[:-1]]
                turn[off[:-1][has]] = False
                switches[has] = np.add.reduceat(turn.astype(np.int64), off[:-1][has])
                if with_spans:
                    for i in np.flatnonzero(has):
                        cut = np.r_[0, np.flatnonzero(turn[off[i] : off[i + 1]]), size[i]]
                        spans[i] = [{"lang": names[top[off[i] + a]], "n_words": int(b - a)} for a, b in zip(cut[:-1], cut[1:], strict=True)]
            out = [pa.array(pred, pa.string()), pa.array(np.round(score, 6)), pa.array(size.astype(np.int64)), pa.array(switches)]
            return out + ([pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("n_words", pa.int64())])))] if with_spans else [])

        return run

    return map_texts(docs, text_col, list(keep), FIELDS + SPANS * with_spans, make)


def op1(docs: DataFrame) -> DataFrame:
    return identified(docs, fit(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
