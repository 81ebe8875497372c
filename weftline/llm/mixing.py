"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). Raking scales the cells' weights in turn until the weighted token
counts meet the target share of every source, language and topic. A document is then sampled with the probability
min(1, c * weight of its cell), c being calibrated (by water filling) so that the expected tokens meet the budget.
The draw is a hash of the id, so it is the same wherever and whenever it runs.

Only cells are gathered: their number is checked against ``CELLS``, below which raking is done in memory and the cells'
figures are broadcast; above it the same steps run as aggregations and joins.

``residual`` tells how far the marginals still are from their targets after the rounds.

Targets default to the tokens' shares raised to a power below 1 (``TEMPER``), which lifts small sources and languages.
The test tables have no topic; a text's form (`topic_of`) stands in for it.

Defined cases: a null in a cell's column is a value of its own; a null or empty text has no tokens, weighs nothing in
the marginals, and is sampled by its cell's probability (a value without tokens scales nothing); no tokens at all give
weight 1 everywhere; given targets for values without tokens are spread over the others in proportion; repeated rows are all
kept or all dropped; a null id draws as an empty one; a text of any length is counted whole; ties in the calibration go in
the order of the cells; an empty table gives no rows; other columns, whatever their names, come back unchanged from ``sampled``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, whole_row

TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.9}
ROUNDS, BUDGET, CELLS = 12, 0.6, 100_000
NULL = "\x00null"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    return F.when(text.contains(" | "), "table").when(tokens < 60, "note").when(tokens < 400, "article").when(tokens < 3000, "report").otherwise("book")


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id: 52 bits of its md5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def in_cells(docs: DataFrame, dims: list[str], tokens: str = "n_tokens") -> DataFrame:
    keys = [F.coalesce(F.col(d).cast("string"), F.lit(NULL)).alias(d) for d in dims]
    return docs.select(*keys, F.col(tokens).alias("t")).groupBy(*dims).agg(F.sum("t").alias("t"))


def targets(cells: DataFrame, dim: str, given: dict[str, float] | None, temper: float) -> DataFrame:
    """value, share of one dimension; with given targets, values that they leave out get none, and values without tokens give up theirs."""
    if given:
        there = cells.groupBy(dim).agg(F.sum("t").alias("t")).where("t > 0").select(dim)
        own = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"`{dim}` string, p double").join(there, dim, "left_semi")
        return own.crossJoin(F.broadcast(own.agg(F.sum("p").alias("all")))).select(dim, (F.col("p") / F.col("all")).alias("share"))
    own = cells.groupBy(dim).agg(F.sum("t").alias("t")).where("t > 0").withColumn("p", F.pow(F.col("t").cast("double"), F.lit(temper)))
    return own.crossJoin(F.broadcast(own.agg(F.sum("p").alias("all")))).select(dim, (F.col("p") / F.col("all")).alias("share"))


def rake_small(keys: list[tuple], t: np.ndarray, shares: list[dict], rounds: int) -> np.ndarray:
    """Weights of cells in memory; shares: of each dimension, by value."""
    w = np.ones(len(t))
    codes, want = [], []
    for i, share in enumerate(shares):
        values, code = np.unique(np.array([k[i] for k in keys], object).astype(str), return_inverse=True)
        codes.append(code)
        want.append(np.array([share.get(v, 0.0) for v in values]))
    total = t.sum()
    if not total:
        return w
    for _ in range(rounds):
        for code, share in zip(codes, want, strict=True):
            have = np.bincount(code, w * t, len(share)) / total
            w = w * np.where(have > 0, share / np.where(have > 0, have, 1), 1.0)[code]
    return w


def residual(keys: list[tuple], t: np.ndarray, w: np.ndarray, shares: list[dict]) -> float:
    """The largest gap between a marginal of the weighted tokens and its target share."""
    total = t.sum() or 1.0
    worst = 0.0
    for i, share in enumerate(shares):
        have: dict = dict.fromkeys(share, 0.0)
        for k, a, b in zip(keys, t, w, strict=True):
            have[k[i]] = have.get(k[i], 0.0) + a * b / total
        worst = max([worst, *(abs(x - share.get(v, 0.0)) for v, x in have.items())])
    return worst


def rake_large(cells: DataFrame, dims: list[str], shares: dict[str, DataFrame], rounds: int) -> DataFrame:
    """The same by aggregations and joins, for more cells than fit in memory."""
    out = cells.withColumn("w", F.lit(1.0))
    total = cells.agg(F.sum("t").alias("s")).first().s or 0
    for _ in range(rounds if total else 0):
        for d in dims:
            have = out.groupBy(d).agg((F.sum(F.col("w") * F.col("t")) / F.lit(float(total))).alias("have"))
            factor = have.join(shares[d], d, "left").select(d, F.when(F.col("have") > 0, F.coalesce("share", F.lit(0.0)) / F.col("have")).otherwise(1.0).alias("f"))
            out = out.join(factor, d).withColumn("w", F.col("w") * F.col("f")).drop("f")
        out = checkpointed(out)
    return out


def scale(w: np.ndarray, t: np.ndarray, budget: float) -> float:
    """c such that the sum of t * min(1, c * w) is budget times the sum of t, or as near as it can be."""
    order = np.argsort(-w, kind="stable")
    w, t = w[order], t[order].astype(float)
    full = np.r_[0, np.cumsum(t)[:-1]]
    rest = np.cumsum((w * t)[::-1])[::-1]
    c = np.where(rest > 0, (budget * t.sum() - full) / np.where(rest > 0, rest, 1), 0)
    ok = np.flatnonzero((rest > 0) & (c * w <= 1))
    return float(c[ok[0]]) if len(ok) else float(1 / w[w > 0].min()) if (w > 0).any() else 1.0


def cell_weights(docs: DataFrame, dims: dict[str, dict[str, float] | None], tokens: str = "n_tokens", temper: dict[str, float] | None = None, rounds: int = ROUNDS, budget: float = BUDGET, most: int = CELLS) -> tuple[DataFrame, bool]:
    """The cells with t (tokens), weight and p (sampling probability); and whether they are few enough to broadcast."""
    names = list(dims)
    spark = docs.sparkSession
    cells = checkpointed(in_cells(docs, names, tokens))
    shares = {d: targets(cells, d, dims[d], (temper or TEMPER).get(d, 1.0)) for d in names}
    small = cells.limit(most + 1).count() <= most
    if small:
        rows = cells.orderBy(*names).collect()
        keys, t = [tuple(r[d] for d in names) for r in rows], np.array([r.t for r in rows], float)
        w = rake_small(keys, t, [{r[d]: r.share for r in shares[d].collect()} for d in names], rounds)
        p = np.minimum(1, scale(w, t, budget) * w) if len(w) else w
        made = [(*k, int(a), float(b), float(c)) for k, a, b, c in zip(keys, t, w, p, strict=True)]
        return spark.createDataFrame(made, ", ".join(f"`{d}` string" for d in names) + ", t long, weight double, p double"), True
    raked = rake_large(cells, names, shares, rounds)
    # water filling by bisection: each step is one sum over the cells
    total = float(raked.agg(F.sum("t").alias("s")).first().s or 0)
    lo, hi = 0.0, float(2.0 / (raked.where("w > 0 AND t > 0").agg(F.min("w").alias("m")).first().m or 1.0))
    for _ in range(60):
        c = (lo + hi) / 2
        got = raked.agg(F.sum(F.col("t") * F.least(F.lit(1.0), F.col("w") * c)).alias("s")).first().s or 0
        lo, hi = (c, hi) if got < budget * total else (lo, c)
    return raked.select(*names, "t", F.col("w").alias("weight"), F.least(F.lit(1.0), F.col("w") * hi).alias("p")), False


def mixed(docs: DataFrame, dims: dict[str, dict[str, float] | None] | None = None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, **options) -> DataFrame:
    """doc_id, n_tokens, topic, weight, p and kept of each row; `carry` adds the row itself as struct `row`.

    dims: the columns that make cells, each with its targets (or None for tempered shares); ``topic`` is the text's form.
    """
    dims = dims or {"source": None, "lang": None, "topic": None}
    own = docs.select(
        F.col(id_col),
        *[F.col(d) for d in dims if d != "topic"],
        n_tokens(F.col(text_col)).alias("n_tokens"),
        *([whole_row(docs).alias("row")] if carry else []),
        F.col(text_col).alias("__text"),
    ).withColumn("topic", topic_of(F.coalesce(F.col("__text"), F.lit("")), F.col("n_tokens"))).drop("__text")
    cells, small = cell_weights(own, dims, **options)
    cells = cells.drop("t").withColumnsRenamed({d: f"__{d}" for d in dims})
    same = [F.coalesce(F.col(d).cast("string"), F.lit(NULL)) == F.col(f"__{d}") for d in dims]
    got = own.join(F.broadcast(cells) if small else cells, same)
    return got.select(F.col(id_col), "n_tokens", "topic", F.round("weight", 9).alias("weight"), F.round("p", 9).alias("p"), (draw(F.col(id_col)) < F.col("p")).alias("kept"), *(["row"] if carry else []))


def op5(docs: DataFrame) -> DataFrame:
    return mixed(docs)


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The documents that are drawn, with all their columns."""
    return mixed(docs, carry=True, **options).where("kept").select("row.*")


def sql(rounds: int = ROUNDS, budget: float = BUDGET) -> str:
    dims = list(TEMPER)
    parts = [
        """d AS (SELECT doc_id, coalesce(source, chr(0) || 'null') AS source, coalesce(lang, chr(0) || 'null') AS lang, text,
  CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS BIGINT) AS n_tokens FROM documents)""",
        "f AS (SELECT *, CASE WHEN contains(text, ' | ') THEN 'table' WHEN n_tokens < 60 THEN 'note' WHEN n_tokens < 400 THEN 'article' WHEN n_tokens < 3000 THEN 'report' ELSE 'book' END AS topic FROM d)",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS t, CAST(1 AS DOUBLE) AS w FROM f GROUP BY source, lang, topic)",
        "total AS MATERIALIZED (SELECT sum(t) AS s FROM c0)",
    ]
    for d in dims:
        parts.append(f"s_{d} AS MATERIALIZED (SELECT {d}, p / sum(p) OVER () AS share FROM (SELECT {d}, pow(sum(t), {TEMPER[d]}) AS p FROM c0 GROUP BY {d} HAVING sum(t) > 0))")
    n = 0
    for _ in range(rounds):
        for d in dims:
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.t, c.w * h.f AS w FROM c{n} c JOIN (SELECT k.{d}, coalesce(share, 0) / have AS f FROM (SELECT {d}, sum(w * t) / (SELECT s FROM total) AS have FROM c{n} GROUP BY {d}) k LEFT JOIN s_{d} USING ({d})) h USING ({d}))")
            n += 1
    parts.append(f"o AS (SELECT *, coalesce(sum(t) OVER (ORDER BY w DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(w * t) OVER (ORDER BY w DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM c{n})")
    parts.append(f"k AS (SELECT max(({budget} * (SELECT s FROM total) - held) / rest) AS c FROM (SELECT *, row_number() OVER (ORDER BY w DESC, source, lang, topic) AS r FROM o WHERE ({budget} * (SELECT s FROM total) - held) / rest * w <= 1 QUALIFY r = 1))")
    u = "CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
    return f"WITH {', '.join(parts)} SELECT doc_id, n_tokens, topic, round(w, 9) AS weight, round(least(1.0, w * (SELECT c FROM k)), 9) AS p, {u} < least(1.0, w * (SELECT c FROM k)) AS kept FROM f JOIN c{n} USING (source, lang, topic)"
