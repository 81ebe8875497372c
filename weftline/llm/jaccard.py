"""N-gram Jaccard join by chosen paths, and near-duplicate classes.

A text is the set of its five-word shingles (words: runs of letters, digits and ``_`` in lower case; a text of one to
four words is one shingle). Two texts are linked if their sets' Jaccard similarity is 0.8 or more.

1. Each distinct set gets a signature of 64 sampled tokens (its smallest under 64 orders): of sets with similarity J
   any one agrees with probability J. Equal sets are one set from here on.
2. Chosen paths: a run sends each set down the branch that its sampled token names, and runs are independent of each
   other. There are so many that a pair at the threshold stays apart in all of them with probability under 1 - RECALL: 6
   runs of one token. Sets that met more than ``SMALL`` others in a bucket go on to 10 fresh runs of two tokens each, and
   those that still did to 13 of three. So a set has at most 29 places in buckets, whatever groups there are.
3. Buckets of at most ``SMALL`` sets are compared by brute force on signatures, which drops a pair only if it agrees in
   under ``AGREE`` of the 64 places (4e-6 at J = 0.8). A bucket that is still larger after the last level holds sets that
   share three sampled tokens: all of it is joined to its first set, without a comparison. What is joined makes candidate
   components.
4. In each candidate component all pairs are decided exactly, on the whole sets. A component of up to ``BLOCK`` sets is one
   task's group. In a larger one each set's distance to a medoid is computed first. With D the number of tokens in which a
   set x differs from the medoid, two sets are linked for certain if 9 (D_x + D_y) <= |x| + |y|, and unlinked for certain
   if 9 |D_x - D_y| > |x| + |y| (the triangle inequality on the sets' differences). Sets are dealt into blocks by D, block
   pairs that these bounds decide are counted without a look at their sets, and only the others are compared, one block
   pair at a time. So a link is lost only if no path of candidates joins its ends; links are counted where they are found
   and never written out as pairs. What the bounds leave of a component of m sets costs up to m / BLOCK copies of its sets.

Result: one row for each document with ``class_id`` (the smallest doc_id that its links reach), ``n_links`` (documents
linked to it, equal texts included) and ``n_copies`` (documents with the same set, itself included).

Defined cases: a null or empty text, or one without a word, has no links and its own id as class; rows that repeat count
as copies; a null id never names a class, but takes part; texts of any length are compared whole; an empty table gives no
rows; other columns, whatever their names, play no part in the join and come back unchanged from ``one_of_each``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, in_slots, map_texts, slots_of, whole_row
from .components import components

WORDS, LEAST, RECALL = 5, 0.8, 0.9999
PLACES, AGREE = 64, 36
LEVELS = 3
SMALL, BLOCK = 1024, 1024  # sets in a bucket that is compared by brute force, and in a block of exact comparisons
SHINGLES = 1_000_000  # in a block of exact comparisons, but for a single larger set
TRIED = 256  # sets of a large component that its medoid is chosen among

_A = (np.random.default_rng(11).integers(1, 2**32, PLACES, dtype=np.uint64) | 1).astype(np.uint32)
_B = np.random.default_rng(12).integers(0, 2**32, PLACES, dtype=np.uint64).astype(np.uint32)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, end to end, and the texts' n + 1 offsets."""
    import xxhash

    clean = pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}\p{N}_]+", " ")
    parts = pc.split_pattern(pc.utf8_trim(clean, " "), " ")
    off = parts.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    coded = parts.flatten().dictionary_encode()
    vocab = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    ids = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[ids] if len(ids) else np.zeros(0, bool)
    if empty.any():
        off, ids = np.r_[0, np.cumsum(~empty)][off], ids[~empty]
    return vocab[ids], off


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, repeats included, and the n + 1 offsets."""
    w, off = word_hashes(texts)
    size = np.diff(off)
    count = np.where(size >= words, size - words + 1, np.minimum(size, 1))
    out_off = np.r_[0, np.cumsum(count)]
    at = np.arange(out_off[-1]) + np.repeat(off[:-1] - out_off[:-1], count)
    last = np.repeat(off[1:], count)
    h = np.zeros(len(at), np.uint64)
    for k in range(words):
        x = w[np.minimum(at + k, len(w) - 1)] if len(w) else w[:0]
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(at + k < last, x, np.uint64(k + 1))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29)), out_off


def signatures(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The 64 sampled tokens of each set; sets without shingles have zeros."""
    n = len(off) - 1
    out = np.zeros((n, PLACES), np.int32)
    has = np.diff(off) > 0
    if has.any():
        x = (h >> np.uint64(32)).astype(np.uint32)
        begin = off[:-1][has]
        for k in range(PLACES):
            out[has, k] = np.minimum.reduceat((x ^ _B[k]) * _A[k], begin).view(np.int32)
    return out


FIELDS = [
    T.StructField("key", T.BinaryType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("sig", T.ArrayType(T.IntegerType())),
]


def sketched(docs: DataFrame, text_col: str, keep: list[str], words: int = WORDS) -> DataFrame:
    """`keep`, key (a digest of the whole set; null for an empty one), n (its size) and sig of each text."""

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            h, off = shingles(texts, words)
            keys, sizes = [], np.zeros(len(texts), np.int32)
            for i in range(len(texts)):
                own = np.unique(h[off[i] : off[i + 1]])
                sizes[i] = len(own)
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            sig = signatures(h, off)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * PLACES), pa.array(sig.ravel()))
            return [pa.array(keys, pa.binary()), pa.array(sizes), lists]

        return run

    return map_texts(docs, text_col, keep, FIELDS, make)


def runs_of(depth: int) -> int:
    """Runs of so many tokens each after which a pair at the threshold has met with probability RECALL."""
    return math.ceil(math.log(1 - RECALL) / math.log(1 - LEAST**depth))


def _paths(depth: int) -> Column:
    """The bucket of a set in each run of a level; levels take tokens that the ones before have not used, as far as there are."""
    first = sum(d * runs_of(d) for d in range(1, depth))
    token = lambda i: F.element_at("sig", (first + i) % PLACES + 1)
    return F.array(*[F.xxhash64(F.lit(depth), F.lit(r), *[token(r * depth + i) for i in range(depth)]) for r in range(runs_of(depth))])


def buckets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, key) of the small buckets, and edges (a, b) that join what is left in large ones; sets that are alone are gone."""
    small: list[DataFrame] = []
    at = sets.select("key", "sig")
    for depth in range(1, LEVELS + 1):
        rows = at.select("key", F.explode(_paths(depth)).alias("path"))
        sizes = checkpointed(rows.groupBy("path").agg(F.count("*").alias("size"), F.min("key").alias("low")).where("size > 1"))
        rows = checkpointed(rows.join(sizes, "path").select("path", "size", "low", "key"))
        small.append(rows.where(F.col("size") <= SMALL).select("path", "key"))
        large = rows.where(F.col("size") > SMALL)
        if depth == LEVELS or large.isEmpty():
            break
        left = checkpointed(large.select("key").distinct())
        at = sets.select("key", "sig", F.xxhash64("key").alias("h"))
        at = in_slots(at, "h", slots_of(left.select(F.xxhash64("key").alias("h")), "h")).join(left, "key")
    out = small[0]
    for s in small[1:]:
        out = out.unionByName(s)
    return out, large.where("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b"))


def by_group(rows: DataFrame, keys: list[str], cols: list[str], schema: T.StructType, fn) -> DataFrame:
    """Apply ``fn(columns of one group) -> rows`` to each group of rows; many groups share a task and its batches."""
    src = rows.repartition(*keys).sortWithinPartitions(*keys).select(F.xxhash64(*keys).alias("__g"), *dict.fromkeys([*keys, *cols]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def flush(tail_from: list[pa.RecordBatch]) -> list:
            t = pa.Table.from_batches(tail_from)
            return fn({c: t.column(c).combine_chunks() for c in cols})

        def emit(out: list) -> Iterator[pa.RecordBatch]:
            if out:
                arrays = [pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

        arrow = pa.schema([pa.field(f.name, {"binary": pa.binary(), "bigint": pa.int64()}[f.dataType.simpleString()]) for f in schema.fields])
        last: tuple | None = None
        for b in batches:
            if not b.num_rows:
                continue
            tags = np.stack([b.column(i).to_numpy(zero_copy_only=False) if b.schema.field(i).type != pa.binary() else np.array([hash(x) for x in b.column(i).to_pylist()]) for i in range(len(keys) + 1)], 1)
            cut = np.flatnonzero((tags[1:] != tags[:-1]).any(1)) + 1
            out: list = []
            if kept and tuple(tags[0]) != last:
                out += flush(kept)
                kept = []
            lo = 0
            for hi in cut:
                out += flush([*kept, b.slice(lo, hi - lo)])
                kept, lo = [], hi
            kept.append(b.slice(lo))
            last = tuple(tags[-1])
            yield from emit(out)
        if kept:
            yield from emit(flush(kept))

    return src.mapInArrow(run, schema)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges from the first node of each component to its others, of a symmetrical matrix of links."""
    n = len(near)
    free, out = np.ones(n, bool), []
    for i in range(n):
        if not free[i]:
            continue
        free[i] = False
        todo = near[i] & free
        reach = todo.copy()
        while todo.any():
            free &= ~todo
            todo = near[todo].any(0) & free
            reach |= todo
        out += [(i, int(k)) for k in np.flatnonzero(reach)]
    return out


def agreeing(sig: np.ndarray) -> np.ndarray:
    """In how many places any two signatures agree."""
    if len(sig) <= 32:
        return (sig[:, None] == sig[None]).sum(2)
    agree = np.zeros((len(sig), len(sig)), np.int16)
    for k in range(PLACES):
        agree += sig[:, k, None] == sig[None, :, k]
    return agree


def _signatures(g: dict[str, pa.Array]) -> np.ndarray:
    return g["sig"].flatten().to_numpy(zero_copy_only=False).reshape(-1, PLACES)


def similar_signatures(g: dict[str, pa.Array]) -> list[tuple[bytes, bytes]]:
    """Edges that join the sets of one bucket that agree in enough places."""
    key = g["key"].to_pylist()
    n = g["n"].to_numpy(zero_copy_only=False).astype(np.float64)
    near = (agreeing(_signatures(g)) >= AGREE) & (np.minimum(n[:, None], n) >= LEAST * np.maximum(n[:, None], n))
    np.fill_diagonal(near, False)
    return [(key[a], key[b]) for a, b in forest(near)]


def central(g: dict[str, pa.Array]) -> list[tuple[bytes, bytes]]:
    """(root, key) of the set whose signature agrees best with the others' of the group."""
    key = g["key"].to_pylist()
    total = agreeing(_signatures(g)).astype(np.int64).sum(1)
    return [(g["root"][0].as_py(), min(zip((-total).tolist(), key, strict=True))[1])]


def exact_links(g: dict[str, pa.Array]) -> list[tuple[bytes, bytes, int]]:
    """Links between the sets of two blocks (or within one): (set, set it reaches, documents linked to it here)."""
    key, own, copies = g["key"].to_pylist(), g["own"].to_numpy(zero_copy_only=False), g["copies"].to_numpy(zero_copy_only=False)
    size = g["n"].to_numpy(zero_copy_only=False).astype(np.int64)
    tokens = [np.frombuffer(x, np.uint64) for x in g["tokens"].to_pylist()]
    m = len(key)
    _, ids = np.unique(np.concatenate(tokens), return_inverse=True)
    doc = np.repeat(np.arange(m), [len(t) for t in tokens])
    times = np.bincount(ids)
    shared = times[ids] > 1
    new = np.cumsum(times > 1) - 1
    ids, doc = new[ids[shared]], doc[shared]
    both = np.zeros((m, m), np.float32)
    order = np.argsort(ids, kind="stable")
    ids, doc = ids[order], doc[order]
    width = max(64, min(8192, 4_000_000 // max(1, m)))
    at = 0
    while at < len(ids):
        stop = int(np.searchsorted(ids, ids[at] + width))
        part = np.zeros((m, width), np.float32)
        part[doc[at:stop], ids[at:stop] - ids[at]] = 1
        both += part @ part.T
        at = stop
    near = both >= LEAST * (size[:, None] + size - both) - 1e-6
    np.fill_diagonal(near, False)
    blocks = np.unique(own)
    edges = forest(near)
    if len(blocks) > 1:
        near &= own[:, None] != own  # pairs within a block are counted where it meets itself
    elif int(g["i"][0].as_py()) != int(g["j"][0].as_py()):
        near[:] = False  # only one of the two blocks has rows
    linked = near @ copies
    out = [(key[a], key[b], 0) for a, b in edges]
    return out + [(key[a], key[a], int(linked[a])) for a in np.flatnonzero(linked)]


def token_sets(docs: DataFrame, text_col: str, keep: list[str], words: int) -> DataFrame:
    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            h, off = shingles(texts, words)
            return [pa.array([np.unique(h[a:b]).tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())]

        return run

    return map_texts(docs, text_col, keep, [T.StructField("tokens", T.BinaryType())], make)


PAIR = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
TRIPLE = T.StructType([*PAIR.fields, T.StructField("links", T.LongType())])
GROUP = ["key", "own", "i", "j", "n", "copies", "tokens"]


def distances(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and d: the number of tokens that are in one only of the sets `tokens` and `middle`."""
    src = rows.select(*keep, "tokens", "middle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (map(lambda x: np.frombuffer(x.as_buffer(), np.uint64), b.column(k)) for k in (len(keep), len(keep) + 1))
            d = [len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, c, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(d, pa.int64())], names=[*keep, "d"])

    return src.mapInArrow(run, T.StructType([*src.schema.fields[: len(keep)], T.StructField("d", T.LongType())]))


def large_components(large: DataFrame, sets: DataFrame) -> DataFrame:
    """The links of TRIPLE within components of more than a block of sets: rows of (root, key, n, copies, tokens)."""
    # a medoid: of a bounded number of sets, the one that agrees best with the others
    order = Window.partitionBy("root").orderBy(F.xxhash64("key"), "key")
    tried = large.select("root", "key").withColumn("k", F.row_number().over(order)).where(F.col("k") <= TRIED)
    one = by_group(tried.join(sets.select("key", "sig"), "key"), ["root"], ["root", "key", "sig"], PAIR, central)
    middle = checkpointed(one.select(F.col("b").alias("key")).join(large, "key").select("root", F.col("tokens").alias("middle")))
    at = checkpointed(distances(large.join(middle, "root"), ["root", "key", "n", "copies"]))
    # blocks in the order of d: the place of a set is the weight of those nearer, and a hash among those as near
    weight = F.lit(1.0 / BLOCK) + F.col("n") / F.lit(float(SHINGLES))
    near = at.groupBy("root", "d").agg(F.sum(weight).alias("w"))
    before = F.coalesce(F.sum("w").over(Window.partitionBy("root").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    near = checkpointed(near.withColumn("first", before))
    place = F.col("first") + F.col("w") * F.shiftrightunsigned(F.xxhash64("key"), 11) / F.lit(2.0**53)
    at = checkpointed(at.join(near, ["root", "d"]).select("root", "key", "n", "copies", "d", F.floor(place).alias("own")))
    per = checkpointed(at.groupBy("root", "own").agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.sum("copies").alias("all"), F.min("key").alias("low")))
    x, y = (per.select("root", *[F.col(c).alias(f"{c}_{t}") for c in per.columns if c != "root"]) for t in "xy")
    pairs = x.join(y, "root")  # blocks, not sets
    gap = F.greatest(F.col("d0_y") - F.col("d1_x"), F.col("d0_x") - F.col("d1_y"), F.lit(0))
    pairs = pairs.withColumn("sure", 9 * (F.col("d1_x") + F.col("d1_y")) <= F.col("n0_x") + F.col("n0_y"))
    pairs = checkpointed(pairs.where(F.col("sure") | (9 * gap <= F.col("n1_x") + F.col("n1_y"))))
    # block pairs that are linked for certain: each set has the other block's documents, and an edge to its first set
    sure = pairs.where("sure").groupBy("root", F.col("own_x").alias("own")).agg(F.sum("all_y").alias("more"), F.min("low_y").alias("hub"), F.max(F.col("own_x") == F.col("own_y")).alias("self"))
    mine = at.join(checkpointed(sure), ["root", "own"])
    counted = mine.select(F.col("key").alias("a"), F.col("key").alias("b"), (F.col("more") - F.when(F.col("self"), F.col("copies")).otherwise(0)).alias("links"))
    tied = mine.select(F.col("key").alias("a"), F.col("hub").alias("b"), F.lit(0).cast("long").alias("links"))
    blocks = pairs.where("sure").select(F.col("low_x").alias("a"), F.col("low_y").alias("b"), F.lit(0).cast("long").alias("links"))
    # the others are compared
    need = pairs.where("NOT sure").select("root", F.col("own_x").alias("own"), F.least("own_x", "own_y").alias("i"), F.greatest("own_x", "own_y").alias("j")).distinct()
    rows = large.select("key", "tokens").join(at, "key").join(need, ["root", "own"])
    return by_group(rows, ["root", "i", "j"], GROUP, TRIPLE, exact_links).unionByName(counted).unionByName(tied.unionByName(blocks).where("a <> b"))


def marked(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS) -> DataFrame:
    """id, mark (a hash of the text), root (names the row's class; null without links), class_id, links and copies of each row of docs."""
    row = F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_col))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), row.alias("h"), F.col(text_col).alias("text"))
    rows = checkpointed(sketched(src, "text", ["id", "mark", "h"], words))
    rep = F.min(F.struct(F.col("id").isNull().alias("x"), "id", "mark", "h"))
    sets = checkpointed(rows.where("key IS NOT NULL").groupBy("key").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), rep.alias("rep"), F.min("id").alias("low"), F.count("*").alias("copies")))

    found, edges = buckets(sets)
    found = by_group(found.join(sets.select("key", "n", "sig"), "key"), ["path"], ["key", "n", "sig"], PAIR, similar_signatures)
    maybe = components(found.unionByName(edges))

    # the whole sets of those in a candidate component, from one text of each
    members = checkpointed(maybe.withColumnRenamed("node", "key").join(sets.select("key", "n", "copies", "rep"), "key"))
    big = (F.col("m") > BLOCK) | (F.col("total") > SHINGLES) & (F.col("m") > 1)
    per = checkpointed(members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("total")).select("root", big.alias("big")))
    want = checkpointed(members.join(per, "root").select("key", "root", "n", "copies", "big", F.col("rep.id").alias("rid"), F.col("rep.mark").alias("rmark"), F.col("rep.h").alias("rh")))

    def whole(part: DataFrame) -> DataFrame:
        """The sets of some components: key, root, n, copies, tokens."""
        texts = in_slots(src, "h", slots_of(part, "rh")).join(part, (F.col("h") == F.col("rh")) & F.col("id").eqNullSafe(F.col("rid")) & (F.col("mark") == F.col("rmark")))
        cols = ["root", "n", "copies"]
        texts = texts.groupBy("h", "key").agg(F.first("text").alias("text"), *[F.first(c).alias(c) for c in cols])  # equal rows
        return token_sets(texts, "text", ["key", *cols], words)

    zero = F.lit(0).cast("long")
    links = by_group(whole(want.where("NOT big")).withColumns({"own": zero, "i": zero, "j": zero}), ["root"], GROUP, TRIPLE, exact_links)
    if not per.where("big").isEmpty():
        links = links.unionByName(large_components(checkpointed(whole(want.where("big"))), sets))
    links = checkpointed(links)

    degree = links.where("a = b").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    joined = components(links.where("a <> b").select("a", "b")).withColumnRenamed("node", "key")
    info = sets.where("copies > 1").select("key").unionByName(joined.select("key")).distinct().join(sets.select("key", "low", "copies"), "key")
    info = info.join(joined, "key", "left").join(degree, "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = checkpointed(info.groupBy("root").agg(F.min("low").alias("class_id")))
    info = checkpointed(info.join(classes, "root").select("key", "root", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links")))
    # a set may have any number of documents: the join is between two plain exchanges, so its partition can be split
    cols = ["id", "mark", "root", "class_id", "links", "copies"]
    got = rows.where("key IS NOT NULL").select("id", "mark", "key").join(info, "key", "left").select(*cols)
    none = {"root": "binary", "class_id": "long", "links": "long", "copies": "long"}
    return got.unionByName(rows.where("key IS NULL").select("id", "mark", *[F.lit(None).cast(t).alias(c) for c, t in none.items()]))


def linked(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS) -> DataFrame:
    """doc_id (as `id_col`), class_id, n_links and n_copies of each row of docs."""
    return marked(docs, text_col, id_col, words).select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def op3(docs: DataFrame) -> DataFrame:
    return linked(docs)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, of which each class keeps one row: that with the smallest doc_id.

    Rows without an id come last, then the smallest hash of the text decides. Rows without links stay as they are, whatever
    ids they share: a class is one of rows, which are found by id and text. Defined cases: see ``linked``; equal rows of a
    class count as one; extra columns stay, whatever their names; an empty table stays empty.
    """
    of = marked(docs).where("root IS NOT NULL").select("id", "mark", "root").distinct()
    of = checkpointed(of)
    best = checkpointed(of.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("x"), "id", "mark")).alias("best")))
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark"))
    of = checkpointed(of.join(best, "root").select(F.xxhash64("id", "mark").alias("k"), F.col("id").alias("i"), F.col("mark").alias("m"), "root", stays.alias("stays")))
    order = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and t != "variant"])
    rows = docs.select(whole_row(docs).alias("row"), order.alias("order"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"))
    rows = rows.withColumn("h", F.xxhash64("id", "mark"))
    slots = slots_of(of, "k")
    found = in_slots(rows, "h", slots).join(of, (F.col("h") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")
    kept = found.where("stays").groupBy("root").agg(F.min_by("row", "order").alias("row"))
    alone = in_slots(rows, "h", slots, inside=False).select("row.*").unionByName(found.where("root IS NULL").select("row.*"))
    return alone.unionByName(kept.select("row.*"))
