"""Centroid clustering filtered by ball trees, in whole numbers.

Vectors become whole numbers, floor(scale * x). Every partition builds trees over some thousands of its vectors as they
come, without a shuffle, and writes them: a node stores its ball's radius, count and integer sum (so its centre, too) and
the range of its vectors. A round takes the centroids through every tree. With d the distance of a ball's centre to its
nearest centroid and r its radius, a centroid further than d + 2r from the centre is nearest to none of the ball's vectors
(the triangle inequality). So balls pass on only the centroids that are left; a ball with one left goes to it as a whole,
by its count and sum, and its vectors are not looked at; leaves that are reached compare their vectors exactly. Sums are
whole numbers, so neither the trees nor the partitions change a result. Each task adds up what its trees gave, a row for
each centroid, and k x dim totals of these reach the driver.

Centroids 0, 1, ... start as the k vectors with the smallest sha256 of ``seed:id``. After each round a non-empty centroid
becomes floor(sum / count) by component, an empty one stays. Distances are squared Euclidean; ties go to the smaller number.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part; a vector
without an id takes part but starts no centroid; rows that repeat are vectors of their own, and of those with one hash the
one with the smaller components starts first; with fewer vectors than k there are as many centroids as there are vectors;
an empty table, or one without an id, gives no rows; other columns, whatever their names, play no part. A scaled component
beyond 2^26 in absolute value raises, as squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

DIM, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
TREE, LEAF = 8192, 32  # vectors in a tree and in a leaf
MOST = 1 << 26  # of a component
EXACT = 1 << 21  # components up to this have squared distances that doubles hold exactly, at up to 1024 of them
SLACK = 1e-9


class Tree:
    """Arrays by node, the root first: centre, radius, count, sum, the range of vectors, and the two nodes below (-1: a leaf)."""

    FIELDS = (("lo", np.int32), ("hi", np.int32), ("left", np.int32), ("right", np.int32), ("radius", np.float64), ("sum", np.int64))

    def __init__(self, ids: list, x: np.ndarray, **nodes: np.ndarray):
        self.ids, self.x = ids, x
        self.__dict__.update(nodes)

    @classmethod
    def build(cls, ids: list, x: np.ndarray, leaf: int = LEAF) -> "Tree":
        rows, nodes = np.arange(len(x)), []
        todo = [(0, len(x), -1, False)]
        while todo:
            lo, hi, above, right = todo.pop()
            own = x[rows[lo:hi]]
            total = own.sum(0)
            d = np.sqrt(((own - total / (hi - lo)) ** 2).sum(1))
            here = len(nodes)
            nodes.append([lo, hi, -1, -1, float(d.max()), total])
            if above >= 0:
                nodes[above][3 if right else 2] = here
            if hi - lo > leaf and d.max() > 0:
                far = own[d.argmax()]  # and the vector that is furthest from it: two poles
                other = own[((own - far) ** 2).sum(1).argmax()]
                along = (own - far) @ (other - far).astype(np.float64)
                order = np.argsort(along, kind="stable")
                rows[lo:hi] = rows[lo:hi][order]
                middle = (lo + hi) // 2
                todo += [(lo, middle, here, False), (middle, hi, here, True)]
        cols = {name: np.array([n[k] for n in nodes], t) for k, (name, t) in enumerate(cls.FIELDS)}
        return cls([ids[i] for i in rows], x[rows], **cols)

    def row(self) -> list:
        return [pa.array([self.ids], pa.list_(pa.int64())), pa.array([self.x.astype(np.int32).tobytes()], pa.binary()), *[pa.array([getattr(self, name).tobytes()], pa.binary()) for name, _ in self.FIELDS]]

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int, dim: int) -> "Tree":
        raw = {name: np.frombuffer(batch.column(k + 2)[i].as_buffer(), t) for k, (name, t) in enumerate(cls.FIELDS)}
        raw["sum"] = raw["sum"].reshape(-1, dim)
        return cls(batch.column(0)[i].values, np.frombuffer(batch.column(1)[i].as_buffer(), np.int32).reshape(-1, dim).astype(np.int64), **raw)

    def filtered(self, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Nodes that are decided, or leaves, and the numbers of the centroids that are left there."""
        centre = self.sum / (self.hi - self.lo)[:, None]
        c = centroids.astype(np.float64)
        todo = [(0, np.arange(len(c)))]
        while todo:
            node, left = todo.pop()
            d = np.sqrt(((c[left] - centre[node]) ** 2).sum(1))
            reach = d.min() + 2 * self.radius[node]
            left = left[d <= reach + SLACK * (1 + reach)]
            if len(left) == 1 or self.left[node] < 0:
                yield node, left
            else:
                todo += [(int(self.left[node]), left), (int(self.right[node]), left)]

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cluster of each vector and its squared distance, exactly."""
        cluster, distance = np.empty(len(self.x), np.int32), np.empty(len(self.x), np.int64)
        for node, left in self.filtered(centroids):
            part = slice(self.lo[node], self.hi[node])
            d = squared(self.x[part], centroids[left])
            best = d.argmin(1)
            cluster[part], distance[part] = left[best], d[np.arange(len(d)), best]
        return cluster, distance

    def totals(self, centroids: np.ndarray, count: np.ndarray, total: np.ndarray) -> int:
        """Add the counts and sums of the vectors nearest to each centroid; returns how many vectors were looked at."""
        seen = 0
        for node, left in self.filtered(centroids):
            lo, hi = self.lo[node], self.hi[node]
            if len(left) == 1:
                count[left[0]] += hi - lo
                total[left[0]] += self.sum[node]
                continue
            own = self.x[lo:hi]
            seen += hi - lo
            best = left[squared(own, centroids[left]).argmin(1)]
            count += np.bincount(best, minlength=len(count))
            np.add.at(total, best, own)
        return seen


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole numbers; the first of equal ones is the smaller centroid's."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:  # every sum in it stays below 2^53
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


def whole(batch: pa.RecordBatch, dim: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and whole numbers of the vectors of a batch that take part."""
    v = batch.column(1)
    size = np.diff(v.offsets.to_numpy())
    fit = np.asarray(v.is_valid()) & (size == dim)
    kept = batch.filter(pa.array(fit))
    x = kept.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # a null is NaN here
    fine = np.isfinite(x).all(1)
    x = np.floor(scale * x[fine])
    if len(x) and np.abs(x).max() > MOST:
        raise ValueError(f"a component is beyond {MOST} when scaled")
    return kept.column(0).filter(pa.array(fine)), x.astype(np.int64)


TREES = "ids array<long>, x binary, lo binary, hi binary, left binary, right binary, radius binary, sum binary"


def trees(rows: DataFrame, id_col: str, vec_col: str, dim: int = DIM, scale: int = SCALE, size: int = TREE) -> DataFrame:
    """Written ball trees over the rows as they come, each over so many vectors of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, held, n = [f.split()[0] for f in TREES.split(", ")], [], [], 0

        def flush():
            nonlocal ids, held, n
            out = pa.RecordBatch.from_arrays(Tree.build(ids, np.concatenate(held)).row(), names=names)
            ids, held, n = [], [], 0
            return out

        for batch in batches:
            own, x = whole(batch, dim, scale)
            own = own.to_pylist()
            at = 0
            while at < len(x):
                step = min(size - n, len(x) - at)
                ids += own[at : at + step]
                held.append(x[at : at + step])
                at, n = at + step, n + step
                if n == size:
                    yield flush()
        if n:
            yield flush()

    src = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    return checkpointed(src.mapInArrow(run, TREES))


def by_tree(found: DataFrame, dim: int, schema: str, fn) -> DataFrame:
    """What ``fn(trees of a task)`` yields: lists of arrays by the schema's columns."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(Tree.of(b, i, dim) for b in batches for i in range(b.num_rows)):
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return found.mapInArrow(run, schema)


def starts(found: DataFrame, k: int, dim: int, seed: int) -> np.ndarray:
    """The first centroids; each task offers its best k."""

    def offered(own: Iterator[Tree]):
        best = lambda: ((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x.tolist()) for t in own for i, x in zip(t.ids.to_pylist(), t.x, strict=True) if i is not None)
        top = heapq.nsmallest(k, best())
        if top:
            yield [pa.array([h for h, _ in top]), pa.array([x for _, x in top], pa.list_(pa.int64()))]

    rows = by_tree(found, dim, "h string, x array<long>", offered).orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64).reshape(-1, dim)


def moved(found: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round. What reaches the driver are k counts and k x dim sums."""
    k, dim = centroids.shape

    def added(own: Iterator[Tree]):
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for t in own:
            t.totals(centroids, count, total)
        yield [pa.array(np.arange(k, dtype=np.int32)), pa.array(count), pa.array(total.tolist(), pa.list_(pa.int64()))]

    sums = [F.sum(F.element_at("total", d + 1)).alias(f"s{d}") for d in range(dim)]
    rows = by_tree(found, dim, "cluster int, n long, total array<long>", added).groupBy("cluster").agg(F.sum("n").alias("n"), *sums).where("n > 0").collect()
    out = centroids.copy()
    for r in rows:
        out[r.cluster] = [r[f"s{d}"] // r.n for d in range(dim)]
    return out


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clustered(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, squared distance, the sums of it over the cluster and over all, and a digest of the final centroid."""
    found = trees(rows, id_col, vec_col, dim, scale)
    centroids = starts(found, k, dim, seed)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], RESULT)
    for _ in range(rounds):
        centroids = moved(found, centroids)

    def lost(own: Iterator[Tree]):
        total = np.zeros(len(centroids), np.int64)
        for t in own:
            np.add.at(total, *t.assigned(centroids))
        yield [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)]

    inertia = {r.cluster: r.t for r in by_tree(found, dim, "cluster int, t long", lost).groupBy("cluster").agg(F.sum("t").alias("t")).collect()}
    by_cluster = np.array([inertia[j] for j in range(len(centroids))], np.int64)
    digests = pa.array([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids])
    everything = sum(inertia.values())

    def given(own: Iterator[Tree]):
        for t in own:
            cluster, distance = t.assigned(centroids)
            yield [t.ids, pa.array(cluster), pa.array(distance), pa.array(by_cluster[cluster]), pa.array(np.full(len(cluster), everything)), digests.take(pa.array(cluster))]

    return by_tree(found, dim, RESULT, given)


def op13(embeddings: DataFrame) -> DataFrame:
    return clustered(embeddings)


def sql(rounds: int = ROUNDS) -> str:
    """The same with lists taken apart: a vector's distance to every centroid in each round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM v JOIN c{r} c USING (i) GROUP BY 1, 2),
a{r} AS MATERIALIZED (SELECT row, cluster, distance FROM d{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT a.cluster, v.i, sum(v.x) AS s, count(*) AS n FROM a{r} a JOIN v USING (row) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, c.i, CASE WHEN s.n IS NULL THEN c.x ELSE CAST((s.s - ((s.s % s.n) + s.n) % s.n) // s.n AS BIGINT) END AS x FROM c{r} c LEFT JOIN s{r} s USING (cluster, i))""")
    last = f"a{rounds}"
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
v AS MATERIALIZED (SELECT row, vec_id, unnest(range(0, {DIM})) AS i, CAST(floor({SCALE} * unnest(e)) AS BIGINT) AS x FROM k),
f AS (SELECT row, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), list_transform(e, lambda x: floor({SCALE} * x))) - 1 AS cluster FROM k WHERE vec_id IS NOT NULL QUALIFY cluster < {K}),
c0 AS MATERIALIZED (SELECT f.cluster, v.i, v.x FROM f JOIN v USING (row)),
{", ".join(steps)},
g AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
SELECT k.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM {last} a JOIN k USING (row) JOIN g USING (cluster)"""
