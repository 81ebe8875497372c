"""Connected components of a graph given as edges, by large-star and small-star steps.

Both steps are aggregations and joins on a node. A node's smallest neighbour is pre-aggregated and written before it is
joined to the node's edges, so that join stands between two plain exchanges: adaptive execution splits the partition of a
node with very many edges, and no step gathers a node's neighbours in one place. Each round is cut off through the shared
checkpoint folder.

Defined cases: edges from a node to itself and repeated edges change nothing; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0)).alias("h")).first()
    return int(r.n), int(r.h)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of all nodes of edges (a, b); nodes may be of any ordered type."""
    e = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = _state(e)
    while state[0]:
        # large star: each node points its larger neighbours at the smallest node around it
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: each node points its smaller neighbours, and itself, at the smallest of them
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))  # after the large star few nodes have more than one smaller neighbour
        small = down.join(low, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b").distinct()
        e = checkpointed(small)
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
