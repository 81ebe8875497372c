"""Nearest vectors with label votes, posting lists, overlap recall."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import unit
from .lineage import cut
from .tokens import MARK

BLOCK = 8192  # vectors in a block of either side
ROWS = 128  # queries of a block whose products are held at a time
POSTINGS = 48
CHUNK = 1 << 20  # words whose postings are counted together
ASKED = 1 << 17  # codes of queries in a block
PAIRS = 1 << 21  # pairs of a query and a key's document that are added up at a time
SIDE = 1 << 14, 1 << 22  # queries and their words in a block that is compared with whole documents
HELD = 1 << 23  # words of documents in such a block
CELLS = 1 << 21  # sums of queries and documents that are held at a time
COMMON = 1024  # words of a block that are compared by a matrix product; the others by their lists


def _unit_rows(df: DataFrame, id_col: str, vec: str, *more: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), unit(F.col(vec)).alias("v"), *more).where("v IS NOT NULL")


def nearest(queries: DataFrame, memory: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """query_id, rank, id, label, sim: the k memory vectors of the largest cosine, ties by id; all vectors of one length.

    Both sides are dealt into blocks; each pair of blocks is one matrix product in one task, which gives k rows a query.
    """
    q, m = _unit_rows(queries, id_col, vec), _unit_rows(memory, id_col, vec, F.col(label).cast("int").alias("label"))
    nq, nm = (max(1, math.ceil(d.count() / BLOCK)) for d in (q, m))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("qb", place(nq)).withColumn("mb", every(nm)).groupBy("qb", "mb")
    right = m.withColumn("mb", place(nm)).withColumn("qb", every(nq)).groupBy("qb", "mb")

    def part(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = (t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 0)) for t in (a, b))
        ids, labels, asked = b.column("id").to_numpy(), b.column("label").to_numpy(), a.column("id").to_numpy()
        out = []
        for lo in range(0, len(x) if len(y) else 0, ROWS):
            s = x[lo : lo + ROWS] @ y.T
            np.round(s, 12, out=s)
            for row, got in zip(asked[lo : lo + ROWS], s, strict=True):
                few = np.flatnonzero(got >= np.partition(got, -k)[-k]) if len(got) > k else np.arange(len(got))
                best = few[np.lexsort((ids[few], -got[few]))][:k]
                out.append((np.full(len(best), row), ids[best], labels[best], got[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "id", "label", "sim"), cols, (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)})

    got = left.cogroup(right).applyInArrow(part, "query_id long, id long, label int, sim double")
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "label", "sim")


def votes(near: DataFrame, k: int) -> DataFrame:
    """query_id, label, p: the similarities above 0 of the k nearest, summed by label and normalised; without any, 0."""
    w = near.where(F.col("rank") <= k).groupBy("query_id", "label").agg(F.sum(F.greatest("sim", F.lit(0.0))).alias("w"))
    all_ = F.sum("w").over(Window.partitionBy("query_id"))
    return w.select("query_id", "label", F.coalesce(F.try_divide(F.col("w"), all_), F.lit(0.0)).alias("p"))


def predictions(voted: DataFrame) -> DataFrame:
    """query_id, pred, p: the label with the largest share, ties to the smallest label."""
    best = F.max_by(F.struct("label", "p"), F.struct(F.round("p", 9).alias("p"), (-F.col("label")).alias("l")))
    return voted.groupBy("query_id").agg(best.alias("b")).select("query_id", F.col("b.label").alias("pred"), F.col("b.p").alias("p"))


def fused(cortex: Column, memory: Column, alpha: Column | float) -> Column:
    """alpha of the model's own and the rest of the retrieved probability."""
    alpha = F.lit(alpha) if isinstance(alpha, float) else alpha
    return alpha * cortex + (1 - alpha) * memory


def adaptive_weight(best: Column, top: float = 0.30) -> Column:
    """Weight of retrieval by the cube of its best match."""
    return F.lit(top) * F.pow(best, F.lit(3))


def mean_overlap(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """n and overlap: mean cosine over all pairs of different rows, from the sum of the unit vectors; no pair is formed."""
    u = _unit_rows(df, id_col, vec)
    sums = u.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"))
    total = sums.agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    n = u.agg(F.count("*").alias("n"))
    return n.crossJoin(total).select("n", F.round(F.try_divide(F.col("q") - F.col("n"), (F.col("n") * (F.col("n") - 1)).cast("double")), 9).alias("overlap"))


def postings(docs: DataFrame, cap: int = POSTINGS, chunk: int = CHUNK) -> DataFrame:
    """key, doc_id, nth, margin: the first `cap` documents of each word in the order of doc_id, and how often each has it; docs: doc_id, tokens.

    A task counts chunks of its documents' words and sends on no more than a word's first `cap` documents of a chunk, nor any
    behind as many that it has sent; so a common word is a few rows of a task, not one for each document.
    """
    late = 2**63 - 1  # a null comes last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, int] = {}  # the greatest document that a word with `cap` of them still has use for
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            row = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            for lo in range(0, len(flat), chunk):
                coded = flat.slice(lo, chunk).dictionary_encode()
                known, at = np.unique(ids[row[lo : lo + chunk]], return_inverse=True)
                pair, times = np.unique(coded.indices.to_numpy().astype(np.int64) * len(known) + at, return_counts=True)
                word, doc = pair // len(known), known[pair % len(known)]
                begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                nth = np.arange(len(word)) - np.repeat(begin, np.diff(np.r_[begin, len(word)]))
                names = coded.dictionary.to_pylist()
                top = np.array([last.get(w, late) for w in names])
                keep = (nth < cap) & (doc <= top[word])
                for w, d in zip(word[nth == cap - 1], doc[nth == cap - 1], strict=True):
                    last[names[w]] = min(int(d), last.get(names[w], late))
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(word[keep])), pa.array(doc[keep]), pa.array(times[keep])], names=["key", "doc_id", "margin"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(late)).alias("doc_id"), "tokens").mapInArrow(run, "key string, doc_id long, margin long")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * docs.rdd.getNumPartitions())
    order, same = Window.partitionBy("key").orderBy("doc_id"), Window.partitionBy("key", "doc_id")
    rows = rows.repartition(parts, "key").withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= cap)
    # parts of a document that several chunks counted; windows over one sort hold no table of the rows
    rows = rows.withColumn("margin", F.sum("margin").over(same)).withColumn("again", F.row_number().over(same.orderBy("doc_id")))
    return rows.where("again = 1").select("key", F.nullif("doc_id", F.lit(late)).alias("doc_id"), "nth", "margin")


def _dealt(codes: DataFrame, index: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Queries' codes in blocks, and the lists of the keys that a block asks for: block, key, docs and `more`.

    So a list is sent once to each block that asks for it, and pairs of a query and a document are formed and added up in the block's task.
    """
    n = max(1, -(-codes.count() // ASKED))
    codes = codes.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int"))
    lists = index.where("doc_id IS NOT NULL").groupBy("key").agg(F.collect_list(F.struct("doc_id", *more)).alias("found"))
    asked = codes.select("key", "block").distinct()
    lists = lists.join(asked, "key").select(F.col("block").alias("block"), "key", F.col("found.doc_id").alias("docs"), *[F.col(f"found.{c}").alias(c) for c in more])
    return codes, lists


def _scored(codes: pa.Table, lists: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some queries at a time their numbers in the order of their ids, a document, an entry of the lists that has it, and the sum of margins."""
    found = lists.column("docs").combine_chunks()
    size, docs = np.diff(found.offsets.to_numpy()), found.flatten().to_numpy()
    known, first, number = np.unique(docs, return_index=True, return_inverse=True)
    keys = pa.chunked_array([*lists.column("key").chunks, *codes.column("key").chunks], pa.string()).combine_chunks().dictionary_encode()
    code = keys.indices.to_numpy()
    place = np.full(len(keys.dictionary), -1)
    place[code[: len(size)]] = np.arange(len(size))
    asked, query = np.unique(codes.column("query_id").to_numpy(), return_inverse=True)
    at = place[code[len(size) :]]
    use = np.flatnonzero(at >= 0)
    use = use[np.argsort(query[use], kind="stable")]
    at, query, margin = at[use], query[use], codes.column("margin").to_numpy()[use]
    begin, ends = np.cumsum(size) - size, np.r_[0, np.cumsum(size[at])]
    turn = np.r_[0, np.flatnonzero(query[1:] != query[:-1]) + 1, len(query)] if len(query) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(turn) - 1:  # as many whole queries as their pairs allow, one at least
        hi = max(lo + 1, int(np.searchsorted(ends[turn], ends[turn[lo]] + PAIRS, "right")) - 1)
        a, b = turn[lo], turn[hi]
        many = size[at[a:b]]
        entry = np.repeat(begin[at[a:b]] - (ends[a:b] - ends[a]), many) + np.arange(many.sum())
        pair = np.repeat(query[a:b], many) * len(known) + number[entry]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
        score = np.add.reduceat(np.repeat(margin[a:b], many)[order], new) if len(new) else np.zeros(0)
        q, d = pair[new] // max(1, len(known)), pair[new] % max(1, len(known))
        other = asked[q] != known[d]
        yield q[other], known[d[other]], first[d[other]], score[other]
        lo = hi


def recall(codes: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """query_id, rank, doc_id, score: documents by the sum of the query's margins over the keys they share.

    codes: query_id, key, margin, the last a whole number, once for each query and key. A document is no answer to itself.
    """

    def best(codes: pa.Table, lists: pa.Table) -> pa.Table:
        asked, out = np.unique(codes.column("query_id").to_numpy()), []
        for q, doc, _, score in _scored(codes, lists):
            order = np.lexsort((doc, -score, q))
            begin = np.r_[0, np.flatnonzero(np.diff(q[order])) + 1] if len(q) else np.zeros(0, np.int64)
            rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)])) + 1
            top = order[rank <= k]
            out.append((asked[q[top]], rank[rank <= k], doc[top], score[top]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "rank", "doc_id", "score"), cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)})

    codes, lists = _dealt(cut(codes), index)
    return codes.groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(best, "query_id long, rank int, doc_id long, score long")


def _numbered(words: pa.Table, others: pa.Table) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], int]:
    """Rows and numbers of the words of two tables of id and t (words with a blank between them), and how many words there are."""
    lists = [pc.split_pattern(t.column("t").combine_chunks(), MARK) for t in (words, others)]
    coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    rows = [np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy())) for x in lists]
    return (rows[0], code[: len(rows[0])]), (rows[1], code[len(rows[0]) :]), len(coded.dictionary)


def _best(q: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties by document, and their ranks."""
    order = np.lexsort((doc, -score, q))
    q = q[order]
    begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
    rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)])) + 1
    top = order[rank <= k]
    return q[rank <= k], doc[top], score[top], rank[rank <= k]


def overlaps(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, rank, doc_id, score: documents by how many of the query's words they have, each as often as the query has it.

    queries and docs: doc_id, tokens; rows of one id are one document, which is no answer to itself. All documents of all words
    count, so all pairs are compared: both sides are dealt into blocks, each pair of blocks is one task, which adds up some
    documents' sums at a time and gives k rows a query.
    """
    size = lambda d: d.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    side = lambda d, t: d.where("doc_id IS NOT NULL AND size(tokens) > 0").select(F.col("doc_id").cast("long").alias("id"), F.array_join(t, MARK).alias("t"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (nq, wq), (nd, wd) = size(queries), size(docs)
    nq = max(1, -(-nq // SIDE[0]), -(-wq // SIDE[1]))
    nd = max(1, -(-wd // HELD), min(parts, -(-nd // 256)))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def part(a: pa.Table, b: pa.Table) -> pa.Table:
        (row, word), (other, has), n = _numbered(a, b)
        asked, row = np.unique(a.column("id").to_numpy()[row], return_inverse=True)
        known, other = np.unique(b.column("id").to_numpy()[other], return_inverse=True)
        pair, margin = np.unique(word * max(1, len(asked)) + row, return_counts=True)  # by word, then query
        word, row = pair // max(1, len(asked)), pair % max(1, len(asked))
        many = np.bincount(word, minlength=n)
        begin = np.cumsum(many) - many
        pair = np.unique(other * n + has)  # by document, then word
        other, has = pair // max(1, n), pair % max(1, n)
        other, has = other[many[has] > 0], has[many[has] > 0]
        work = many * np.bincount(has, minlength=n)
        common = np.flatnonzero(work > 4 * len(asked))
        common = common[np.argsort(-work[common], kind="stable")][:COMMON]
        column = np.full(n, -1)
        column[common] = np.arange(len(common))
        kind = np.float32 if margin.sum() < 1 << 24 or np.bincount(row, margin).max() < 1 << 24 else np.float64  # whole numbers are exact in it
        left = np.zeros((len(asked), len(common)), kind)
        mine = column[word] >= 0
        left[row[mine], column[word[mine]]] = margin[mine]
        step = max(1, CELLS // max(1, len(asked)))
        bar, held, waiting = np.zeros(len(asked)), [], 0
        for lo in range(0, len(known), step):  # documents in the order of their ids: a later one of an equal sum comes behind
            hi = min(len(known), lo + step)
            x, y = np.searchsorted(other, (lo, hi))
            d, w = other[x:y] - lo, has[x:y]
            right = np.zeros((hi - lo, len(common)), kind)
            mine = column[w] >= 0
            right[d[mine], column[w[mine]]] = 1
            got = right @ left.T
            d, w = d[~mine], w[~mine]
            ends = np.cumsum(many[w])
            at = 0
            while at < len(w):  # lists of rarer words, as many as are to be held at a time
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
                m = many[w[at:to]]
                entry = np.repeat(begin[w[at:to]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                cell = np.repeat(d[at:to], m) * len(asked) + row[entry]
                got += np.bincount(cell, margin[entry], minlength=got.size).reshape(got.shape).astype(kind)
                at = to
            own = np.searchsorted(asked, known[lo:hi])
            own = np.where((own < len(asked)) & (asked[np.minimum(own, len(asked) - 1)] == known[lo:hi]), own, -1) if len(asked) else np.full(hi - lo, -1)
            got[np.flatnonzero(own >= 0), own[own >= 0]] = 0
            doc, q = np.nonzero(got > bar)
            held.append((q, known[lo + doc], got[doc, q].astype(np.int64)))
            waiting += len(q)
            if waiting > CELLS // 4:
                q, doc, score, rank = _best(*(np.concatenate(c) for c in zip(*held, strict=True)), k)
                bar[q[rank == k]] = score[rank == k]
                held, waiting = [(q, doc, score)], 0
        q, doc, score, _ = _best(*(np.concatenate(c) for c in zip(*held, strict=True)), k) if held else [np.zeros(0, np.int64)] * 4
        return pa.table({"query_id": pa.array(asked[q], pa.int64()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())})

    left = side(queries, F.col("tokens")).withColumn("qb", place(nq)).withColumn("db", every(nd)).groupBy("qb", "db")
    right = side(docs, F.array_distinct("tokens")).withColumn("db", place(nd)).withColumn("qb", every(nq)).groupBy("qb", "db")
    got = left.cogroup(right).applyInArrow(part, "query_id long, doc_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def recalled(codes: DataFrame, index: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, label, p and best: the vote of the documents that share keys with a query, and the best match.

    codes: query_id, key, margin, the last a whole number, once for each query and key; labels: doc_id, label. A match is the share of the query's margins on common keys; it votes
    with its cube. A document is no answer to itself.
    """

    def vote(codes: pa.Table, lists: pa.Table) -> pa.Table:
        asked, query = np.unique(codes.column("query_id").to_numpy(), return_inverse=True)
        own = np.bincount(query, codes.column("margin").to_numpy(), minlength=len(asked))
        labels = lists.column("labels").combine_chunks().flatten()  # of each entry, the labels of its document
        begin, size = labels.offsets.to_numpy()[:-1] - labels.offsets[0].as_py(), np.diff(labels.offsets.to_numpy())
        coded = labels.flatten().field(0).dictionary_encode()
        names = pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)])
        code = coded.indices.fill_null(len(coded.dictionary)).to_numpy()
        out = []
        for q, _, entry, score in _scored(codes, lists):
            many = size[entry]
            which = np.repeat(begin[entry] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            q, s = np.repeat(q, many), np.repeat(score / own[q], many)
            pair, at = np.unique(q * len(names) + code[which], return_inverse=True)
            w, top = np.bincount(at, s**3, minlength=len(pair)), np.zeros(len(pair))
            np.maximum.at(top, at, s)
            q = pair // len(names)
            mass, best = np.bincount(q, w, minlength=len(asked)), np.zeros(len(asked))
            np.maximum.at(best, q, top)
            out.append((asked[q], pair % len(names), w / mass[q], best[q]))
        q, label, p, best = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 4
        return pa.table({"query_id": pa.array(q, pa.int64()), "label": names.take(pa.array(label, pa.int64())), "p": pa.array(p, pa.float64()), "best": pa.array(best, pa.float64())})

    codes = cut(codes.where("margin > 0"))
    kind = labels.schema["label"].dataType.simpleString()
    each = labels.groupBy("doc_id").agg(F.collect_list(F.struct("label")).alias("labels"))
    index = index.join(codes.select("key").distinct(), "key", "left_semi").select("key", "doc_id").join(each, "doc_id")
    codes, lists = _dealt(codes, index, "labels")
    return codes.groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(vote, f"query_id long, label {kind}, p double, best double")
