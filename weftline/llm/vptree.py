"""Approximate nearest neighbours by vantage-point trees, one for each shard.

Nearness is the largest inner product. A shard's tree holds the directions of its vectors, so that it does not depend on
norms; each inner node has a vantage point and the median distance to it, and each node the largest norm in it. A vector
of norm M or less that beats the score s of the k-th neighbour so far has a cosine of more than s / (|query| M): that
bounds how far its direction is from the query's, for each node by the node's own M. A search enters the side that a query
lies on, then the other one unless the triangle inequality shows that nothing there is near enough: unless |distance -
median| exceeds ``factor`` times that bound. Nodes whose M is too small for s are left out. With factor 1 that is exact; a
smaller one prunes more. How small it may be depends on the data: of few intrinsic dimensions, distances vary, and a factor
that is right for many dimensions loses neighbours. So unless a factor is given, each shard finds its own: it asks for the
neighbours of ``SAMPLE`` of its vectors, compares them with the exact ones, and takes the first of ``FACTORS`` that finds
``RECALL`` of them; the last is 1.

Each shard is one stream of rows in one task: its vectors come first, and its tree is built of them once; then the queries
come, batch by batch, and each gets its k nearest there. Only very many queries are dealt into blocks (of ``BLOCK``), for
each of which the shard is built again elsewhere; so a vector is shuffled once for each block, and a task holds a shard and
a batch. Scores are inner products of the given vectors in double precision.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows without an id, take no part;
vectors of another length than the query's are no candidates; rows that repeat id and vector count once, but an id may have
several vectors: each is a candidate of its own, and each asks, with ranks of its own (``mark``, a hash of the asking vector, tells
them apart); only the asking row itself is no candidate; ties go to the smaller id; a query with fewer candidates than k gets them
all; an empty table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, FACTOR = 20, 0.2
FACTORS, RECALL, SAMPLE = (FACTOR, 0.3, 0.4, 0.55, 0.75, 1.0), 0.97, 128  # tried in a shard, the share to be found, and its vectors that ask
SHARD, BLOCK, LEAF = 16_384, 1 << 20, 128  # vectors in a shard, queries in a block, vectors in a leaf (unless they are alike)
ROWS, SCORES = 4096, 2_000_000  # queries that are searched for at a time, scores of them that are held at a time
SLACK = 1e-7  # distances of equal directions are rounded by so much


class Tree:
    """A vantage-point tree over points of norm 1, the directions of vectors with these norms."""

    def __init__(self, points: np.ndarray, norms: np.ndarray, leaf: int = LEAF):
        self.points, self.norms, self.leaf = points, norms, leaf
        self.rng = np.random.default_rng(5)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        top = float(self.norms[rows].max())
        if len(rows) <= self.leaf:
            return top, rows
        vantage = self.points[rows[self.rng.integers(len(rows))]]
        d = distance(self.points[rows] @ vantage)
        middle = float(np.median(d))
        near = d <= middle
        if near.all():
            return top, rows  # no distance parts them
        return top, vantage, middle, self._build(rows[near]), self._build(rows[~near])

    def visit(self, node, queries: np.ndarray, rows: np.ndarray, found: "Found", factor: float) -> None:
        """Search a subtree for these rows of queries."""
        rows = rows[found.reach(rows, node[0]) >= 0]
        if not len(rows):
            return
        if len(node) == 2:
            step = max(1, SCORES // len(node[1]))  # vectors that no distance parts may be very many
            for lo in range(0, len(rows), step):
                found.add(rows[lo : lo + step], node[1])
            return
        _, vantage, middle, inside, outside = node
        d = distance(queries[rows] @ vantage)
        near = d <= middle
        self.visit(inside, queries, rows[near], found, factor)
        self.visit(outside, queries, rows[~near], found, factor)
        for other, mine in ((outside, near), (inside, ~near)):
            may = np.abs(d[mine] - middle) <= factor * found.reach(rows[mine], other[0]) + SLACK
            self.visit(other, queries, rows[mine][may], found, factor)


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


class Found:
    """The k best candidates of each query so far."""

    def __init__(self, queries: np.ndarray, asking: list[np.ndarray], vectors: np.ndarray, own: list[np.ndarray], k: int, norms: np.ndarray):
        """asking and own: the id and the mark of each query and each vector."""
        self.q, self.asking, self.x, self.own, self.ids, self.k, self.norms = queries, asking, vectors, own, own[0], k, norms
        self.score = np.full((len(queries), k), -np.inf)
        self.at = np.full((len(queries), k), -1, np.int64)

    def reach(self, rows: np.ndarray, top: float) -> np.ndarray:
        """Distance within which the direction of a vector of norm `top` or less lies if it reaches the k-th candidate.

        Infinite as long as there are fewer; 2, the largest distance of all, if the k-th score is negative; -1 if no such
        vector reaches it.
        """
        worst = self.score[rows, -1]
        cosine = np.where(np.isfinite(worst), worst, 0) / (self.norms[rows] * top)
        far = np.where(cosine > 1 + 1e-9, -1.0, np.where(cosine < 0, 2.0, distance(cosine)))
        return np.where(np.isfinite(worst), far, np.inf)

    def add(self, rows: np.ndarray, leaf: np.ndarray) -> None:
        s = self.q[rows] @ self.x[leaf].T
        s[(self.asking[0][rows][:, None] == self.own[0][leaf]) & (self.asking[1][rows][:, None] == self.own[1][leaf])] = -np.inf
        better = s.max(1) >= self.score[rows, -1]
        rows, s = rows[better], s[better]
        if not len(rows):
            return
        score = np.concatenate([self.score[rows], s], 1)
        at = np.concatenate([self.at[rows], np.broadcast_to(leaf, s.shape)], 1)
        if score.shape[1] > 2 * self.k:  # all that reach the k-th score, ties included, then sort few
            cut = np.partition(score, -self.k, axis=1)[:, -self.k, None]
            width = int((score >= cut).sum(1).max())
            few = np.argsort(-score, axis=1, kind="stable")[:, :width] if width < score.shape[1] else None
            if few is not None:
                score, at = np.take_along_axis(score, few, 1), np.take_along_axis(at, few, 1)
        order = np.lexsort((np.where(at < 0, 2**62, self.ids[at]), -score))[:, : self.k]
        self.score[rows] = np.take_along_axis(score, order, 1)
        self.at[rows] = np.where(np.isfinite(self.score[rows]), np.take_along_axis(at, order, 1), -1)


class Shard:
    """The vectors of one shard, and a tree for each length that they have."""

    def __init__(self, rows: pa.Table):
        self.trees: dict[int, tuple[np.ndarray, list[np.ndarray], Tree]] = {}
        self.factors: dict[tuple[int, int], float] = {}
        for dim, x, own in by_length(rows):
            norms = np.linalg.norm(x, axis=1)
            self.trees[dim] = x, own, Tree(x / norms[:, None], norms)

    def calibrated(self, dim: int, k: int) -> float:
        """The smallest factor of FACTORS with which a sample of the shard finds RECALL of its k nearest here (equal scores count)."""
        x, own, tree = self.trees[dim]
        rows = np.sort(np.random.default_rng(7).choice(len(x), min(SAMPLE, len(x)), replace=False))
        asking, norm = [o[rows] for o in own], tree.norms[rows]
        exact = Found(x[rows], asking, x, own, k, norm)
        for lo in range(0, len(rows), 16):
            exact.add(np.arange(lo, min(lo + 16, len(rows))), np.arange(len(x)))
        have = np.isfinite(exact.score)
        worst = np.where(have, exact.score, np.inf).min(1, keepdims=True)
        for factor in FACTORS[:-1]:
            found = Found(x[rows], asking, x, own, k, norm)
            tree.visit(tree.root, x[rows] / norm[:, None], np.arange(len(rows)), found, factor)
            if (np.isfinite(found.score) & (found.score >= worst)).sum() >= RECALL * have.sum():
                return factor
        return FACTORS[-1]

    def search(self, queries: pa.Table, k: int, factor: float | None = None) -> Iterator[pa.RecordBatch]:
        """query_id, mark, vec_id, score of the k nearest here of each query."""
        for dim, q, asking in by_length(queries):
            if dim not in self.trees:
                continue
            x, own, tree = self.trees[dim]
            if factor is None and (dim, k) not in self.factors:
                self.factors[dim, k] = self.calibrated(dim, k)
            norm = np.linalg.norm(q, axis=1)
            found = Found(q, asking, x, own, k, norm)
            tree.visit(tree.root, q / norm[:, None], np.arange(len(q)), found, self.factors[dim, k] if factor is None else factor)
            r, c = np.nonzero(found.at >= 0)
            at = found.at[r, c]
            cols = [asking[0][r], asking[1][r], own[0][at], np.einsum("ij,ij->i", q[r], x[at])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "mark", "vec_id", "score"])


def by_length(rows: pa.Table) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Of each length of vectors: the length, a matrix of them, their ids and marks."""
    size = rows.column("dim").to_numpy()
    for dim in np.unique(size):
        part = rows.filter(pa.array(size == dim)) if (size != dim).any() else rows
        v = part.column("v").combine_chunks()
        yield int(dim), v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), [part.column(c).to_numpy() for c in ("vec_id", "mark")]


def searched(batches: Iterator[pa.RecordBatch], k: int, factor: float | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and block, vectors (not `ask`) before queries: search each shard as its queries come."""
    at, held, shard = None, [], None
    for b in batches:
        if not b.num_rows:
            continue
        place = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "block", "ask")], 1)
        cut = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if at != tuple(place[lo][:2]):
                at, held, shard = tuple(place[lo][:2]), [], None
            rows = b.slice(lo, hi - lo)
            if not place[lo][2]:
                held.append(rows)
                continue
            if shard is None and held:
                shard, held = Shard(pa.Table.from_batches(held)), []
            if shard is not None:
                for first in range(0, rows.num_rows, ROWS):
                    yield from shard.search(pa.Table.from_batches([rows.slice(first, ROWS)]), k, factor)


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, mark (a hash of the vector), v (doubles) and dim of the rows that take part; equal rows are one."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    v = F.col(vec_col).cast("array<double>")
    got = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", bad), F.lit(True)))
    got = got.where(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) > 0)
    return got.groupBy("vec_id", "v").agg(F.lit(1).alias("__one")).select("vec_id", F.xxhash64("v").alias("mark"), "v", F.size("v").cast("long").alias("dim"))


def nearest(rows: DataFrame, is_query: Column, k: int = K, factor: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score and mark of the k nearest that are found for each query; is_query: a condition on vec_id."""
    own = usable(rows, id_col, vec_col)
    size = own.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    shards, blocks = max(1, math.ceil(size.n / SHARD)), max(1, math.ceil(size.q / BLOCK))
    place = lambda n: F.pmod(F.xxhash64("vec_id", "mark"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cols = ["shard", "block", "ask", "vec_id", "mark", "dim", "v"]
    asking = own.where(is_query).withColumns({"ask": F.lit(True), "block": place(blocks)}).withColumn("shard", every(shards)).select(*cols)
    held = own.withColumns({"ask": F.lit(False), "shard": place(shards)}).withColumn("block", every(blocks)).select(*cols)
    both = held.unionByName(asking).repartition("shard", "block").sortWithinPartitions("shard", "block", "ask")
    part = both.mapInArrow(lambda batches: searched(batches, k, factor), "query_id long, mark long, vec_id long, score double")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "mark")


def op6(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.col("vec_id") % 20 == 0)
