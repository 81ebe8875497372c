"""Relays: sparse codes thrown onto a few random signs, and a banded search for documents whose relays point the same way.

A code is a set of (key, margin). Each key has a row of signs, the bits of its md5, so no matrix is stored or sent; a
document's relay is the sum of its keys' rows times their margins, made to the length sqrt(dims). Two relays' cosine
estimates that of the codes. For the search the signs of a relay are cut into bands; documents that agree in all signs of a
band are candidates, and their relays decide. Keys should be such that few documents share one, as in capped posting lists:
then buckets are small. A bucket's queries and documents meet in one task, which gives k rows for each query; no pair is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

DIMS, BAND = 128, 16  # signs (at most the 128 bits of an md5), and of them in a band
SHARE = 1 << 16  # rows of bands that are searched together
MOST_SENT = 1 << 20  # buckets that are sent to all tasks
PAIRS = 1 << 16  # pairs whose products are held at a time


def sums(codes: DataFrame, dims: int = DIMS) -> DataFrame:
    """doc_id and s, an array of signed sums of whole margins; codes: doc_id, key, margin. Keys are brought to their document first: a row of sums is as long as a relay."""
    h = F.md5(F.col("key").cast("binary"))
    rows = codes.select("doc_id", "key", "margin").repartition("doc_id").select("doc_id", "margin", *[F.conv(F.substring(h, 8 * g + 1, 8), 16, 10).cast("long").alias(f"h{g}") for g in range(-(-dims // 32))])
    sign = lambda j: F.shiftright(F.col(f"h{j // 32}"), j % 32).bitwiseAND(F.lit(1)) * 2 - 1
    got = rows.groupBy("doc_id").agg(*[F.sum(sign(j) * F.col("margin")).alias(f"s{j}") for j in range(dims)])
    return got.select("doc_id", F.array(*[F.col(f"s{j}").cast("double") for j in range(dims)]).alias("s"))


def relayed(codes: DataFrame, dims: int = DIMS) -> DataFrame:
    """doc_id and relay, of the length sqrt(dims)."""
    length = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    return sums(codes, dims).withColumn("l", length).select("doc_id", F.transform("s", lambda x: x * F.sqrt(F.lit(float(dims))) / (F.col("l") + 1e-6)).alias("relay"))


def near(codes: DataFrame, is_query, k: int, dims: int = DIMS, band: int = BAND) -> DataFrame:
    """query_id, rank, doc_id, cos: the k candidates of the largest cosine, ties by id; a document is no answer to itself."""
    rows = cut(sums(codes, dims).withColumn("s", F.transform("s", lambda x: x.cast("int"))).where(F.exists("s", lambda x: x != 0)))
    value = lambda b: sum((F.when(F.element_at("s", b * band + j + 1) >= 0, 1 << j).otherwise(0) for j in range(band)), F.lit(0))
    bands = dims // band
    parts = max(1, -(-rows.count() * bands // SHARE))
    place = F.posexplode(F.array(*[value(b) for b in range(bands)])).alias("band", "value")
    banded = rows.select("doc_id", "s", place).select("doc_id", "s", (F.col("band") * (1 << band) + F.col("value")).cast("long").alias("bucket"))
    banded = banded.withColumn("part", F.pmod(F.xxhash64("bucket"), F.lit(parts)).cast("int"))
    asked = banded.where(is_query).select(*[F.col(c).alias(c) for c in ("doc_id", "s", "bucket", "part")])
    used = asked.select(F.col("bucket").alias("b")).distinct()  # at most 2^band of each band
    found = banded.join(F.broadcast(used) if bands << band <= MOST_SENT else used, F.col("bucket") == F.col("b"), "left_semi")

    def best(queries: pa.Table, docs: pa.Table) -> pa.Table:
        side = lambda t: (t.column("doc_id").to_numpy(), t.column("bucket").to_numpy(), t.column("s").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1))
        (qid, qb, x), (did, db, y) = side(queries), side(docs)
        order = np.lexsort((did, db))
        did, db, y = did[order], db[order], y[order]
        lo, hi = np.searchsorted(db, qb, "left"), np.searchsorted(db, qb, "right")
        out = []
        for i in range(len(qid)):
            top = None
            for at in range(lo[i], hi[i], PAIRS):
                to = min(hi[i], at + PAIRS)
                a, c = x[i].astype(float), y[at:to].astype(float)
                cos = np.round(c @ a / (np.sqrt(a @ a) * np.sqrt((c * c).sum(1))), 9)
                ids = did[at:to]
                if top is not None:
                    ids, cos = np.r_[top[0], ids], np.r_[top[1], cos]
                other = ids != qid[i]
                ids, cos = ids[other], cos[other]
                first = np.lexsort((ids, -cos))[:k]
                top = ids[first], cos[first]
            if top is not None:
                out.append((np.full(len(top[0]), qid[i]), *top))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "doc_id", "cos"), cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    got = asked.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(best, "query_id long, doc_id long, cos double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("cos"), "doc_id")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "cos")
