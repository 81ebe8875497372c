"""Drawing words from n-gram counts, for many chains at once.

A table has each context's successors as adjoining intervals [lo, hi) as wide as their counts, the most frequent first. A
chain draws a whole number below its context's total; the interval that holds it is the next word. To find it by an
equi-join, a context's range is cut into as many slots of equal width as it has successors: an interval is listed in each
slot that it touches, which doubles the table at most, and a chain asks for one slot, which a few intervals share. So a
frequent context is many keys and no chain meets all of its successors. Each step moves all chains on by one join for
each length of context, from the longest down to none, whose one slot is the whole vocabulary's.

Draws are hashes of (seed, chain, step), so a run is the same whatever the partitions. A temperature other than 1 raises the
counts to its inverse, in units of a millionth of the context's largest; 0 takes the most frequent successor, ties by bytes.

For contexts of two words and a temperature of 1 there is a packed table (`packed_successors`, `drawn`): a part holds all successors
of its contexts in one compressed row. The table is dealt and written once, and a step sends only the chains to their contexts'
parts. Chains whose context is unknown go on to the part of the shorter one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import unit_draw
from . import packed, tokens, vocab
from .lineage import cut, cut_by
from .ngrams import counts
from .ranking import _numbers, _pack, _planes, _unpack

STEPS = 24  # fixed value: words that are drawn
MOST_SENT = 1_000_000  # chains whose contexts are sent to the table, so that it isn't shuffled in each step; more are joined by shuffles
UNIT = 1_000_000  # of the largest weight, at other temperatures than 1


def weight(count: Column, most: Column, temperature: float) -> Column:
    if temperature == 1:
        return count
    return F.greatest(F.lit(1), F.bround(F.pow(count / most, F.lit(1 / temperature)) * UNIT).cast("long"))


def successors(train: DataFrame, most: int, temperature: float = 1.0) -> DataFrame:
    """len, context, slot, word, lo, hi, total and width for contexts of up to `most` tokens; `train` is a stream of words.

    The running sums of a context go over its distinct successors; those of the empty context are the vocabulary.
    """
    out = None
    for n in range(most + 1):
        part = counts(train, n + 1).select(F.lit(n).alias("len"), F.array_join(F.slice("gram", 1, n), " ").alias("context") if n else F.lit("").alias("context"), F.element_at("gram", -1).alias("word"), "cnt")
        out = part if out is None else out.unionByName(part)
    by = Window.partitionBy("len", "context")
    if temperature <= 0:
        best = out.withColumn("r", F.row_number().over(by.orderBy(F.desc("cnt"), "word"))).where("r = 1")
        return best.select("len", "context", F.lit(0).cast("long").alias("slot"), "word", F.lit(0).cast("long").alias("lo"), F.lit(1).cast("long").alias("hi"), F.lit(1).cast("long").alias("total"), F.lit(1).cast("long").alias("width"))
    rows = out.withColumn("w", weight(F.col("cnt"), F.max("cnt").over(by), temperature))
    before = F.coalesce(F.sum("w").over(by.orderBy(F.desc("cnt"), "word").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("len", "context", "word", before.alias("lo"), (before + F.col("w")).alias("hi"), F.sum("w").over(by).alias("total"), F.count("*").over(by).alias("k"))
    width = F.greatest(F.lit(1), F.floor(F.col("total") / F.col("k"))).cast("long")
    rows = rows.withColumn("width", width)
    slot = lambda c: F.floor(c / F.col("width")).cast("long")
    return rows.withColumn("slot", F.explode(F.sequence(slot(F.col("lo")), slot(F.col("hi") - 1)))).select("len", "context", "slot", "word", "lo", "hi", "total", "width")


def generated(seeds: DataFrame, table: DataFrame, most: int, steps: int = STEPS, seed: int = 0, every: int = 8) -> DataFrame:
    """chain, words (array of the words drawn) and backed (how many came from a shorter context than `most`).

    seeds: chain, context (array of words, of which the last `most` count); table: from `successors`, written.
    """
    sizes = cut(table.groupBy("len", "context").agg(F.max("total").alias("total"), F.max("width").alias("width")))
    now = cut(seeds.select("chain", F.col("context").alias("seen"), F.array().cast("array<string>").alias("words"), F.lit(0).alias("backed")))
    few = now.count() <= MOST_SENT
    for step in range(steps):
        rows = now
        for n in range(most, -1, -1):
            own = F.array_join(F.slice("seen", -n, n), " ") if n else F.lit("")
            key = F.when(F.size("seen") >= n, own)
            have = sizes.where(F.col("len") == n)
            if few and n:
                have = have.join(F.broadcast(now.select(key.alias("context")).distinct()), "context", "left_semi")
            have = have.select(F.col("context").alias(f"c{n}"), F.col("total").alias(f"t{n}"), F.col("width").alias(f"w{n}"))
            rows = rows.withColumn("key", key).join(F.broadcast(have) if n == 0 else have, F.col("key") == F.col(f"c{n}"), "left").drop("key")
        first = lambda f: F.coalesce(*[F.when(F.col(f"t{n}").isNotNull(), f(n)) for n in range(most, -1, -1)])
        rows = rows.select("chain", "seen", "words", "backed", first(lambda n: F.lit(n)).alias("len"), first(lambda n: F.col(f"c{n}")).alias("context"), first(lambda n: F.col(f"t{n}")).alias("total"), first(lambda n: F.col(f"w{n}")).alias("width"))
        u = unit_draw(F.concat_ws(":", F.lit(seed), F.col("chain"), F.lit(step)))
        rows = rows.withColumn("at", F.floor(u * F.col("total")).cast("long")).withColumn("slot", F.floor(F.col("at") / F.col("width")).cast("long"))
        keys, listed = ["len", "context", "slot"], table.select("len", "context", "slot", "word", "lo", "hi")
        if few:
            rows = cut(rows)
            listed = listed.join(F.broadcast(rows.select(*keys).distinct()), keys, "left_semi")
        got = rows.join(listed, keys).where((F.col("lo") <= F.col("at")) & (F.col("at") < F.col("hi")))
        grown = F.concat("seen", F.array("word"))
        now = got.select("chain", F.slice(grown, F.greatest(F.lit(1), F.size(grown) - max(most, 1) + 1), max(most, 1)).alias("seen"), F.concat("words", F.array("word")).alias("words"), (F.col("backed") + (F.col("len") < most).cast("int")).alias("backed"))
        if few or (step + 1) % every == 0:
            now = cut(now)  # plans must not grow with the number of steps
    return now.select("chain", "words", "backed")


SHARE = 1 << 21  # tokens of a part of the packed table
LEAST = 1 << 17  # a part of fewer tokens is not worth a task
TABLE = "part int, words binary, contexts binary, sizes binary, next binary, times binary"
STATE = "chain long, words string, a string, b string, backed int, len int, moved boolean"


def _listed(part: int, ids: np.ndarray, times: np.ndarray, names: pa.Array) -> pa.Table:
    """A row of the packed table: its words in the order of their bytes, contexts, how many successors each has, and these with their counts, the most frequent first."""
    used, number = np.unique(ids, return_inverse=True)
    words = names.take(pa.array(used))
    order = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ids = rank[number.reshape(ids.shape)]
    context = ids[:, 0] * len(words) + ids[:, 1]
    by = np.lexsort((ids[:, 2], -times, context))
    begin = np.flatnonzero(np.r_[True, np.diff(context[by]) != 0][: len(by)])
    sizes = np.diff(np.r_[begin, len(by)])
    row = [packed.spelled(words.take(pa.array(order))), *(_pack(_planes(x)) for x in (ids[by[begin], :2], sizes[:, None], ids[by, 2:], times[by, None]))]
    return pa.table({n: pa.array([x], t) for n, x, t in zip(("part", "words", "contexts", "sizes", "next", "times"), (part, *row), [pa.int32()] + [pa.binary()] * 5, strict=True)})


def packed_successors(train: DataFrame) -> tuple[DataFrame, int, int]:
    """The packed table of a led stream's contexts of two words, one and none, written, and how many parts the first two have."""
    spark = train.sparkSession
    total = train.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n2 = max(1, -(-total // SHARE), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // LEAST))
    n1 = -(-n2 // 4)
    known = packed.frequent(train)
    shared = spark.sparkContext.broadcast(known)

    def combine(x: np.ndarray, depth: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n = max(1, len(code))
        at = np.flatnonzero(depth >= 2)
        key, times = np.unique((x[at - 2] * n + x[at - 1]) * n + x[at], return_counts=True)
        a, b = key // n // n, key // n % n
        yield (code[a] * 31 + code[b]) % n2, np.stack([a, b, key % n], 1), times
        at = np.flatnonzero(depth >= 1)
        key, times = np.unique(x[at - 1] * n + x[at], return_counts=True)
        b = key // n
        yield n2 + code[b] % n1, np.stack([b, b, key % n], 1), times

    def collected(got: pa.Table) -> pa.Table:
        return _listed(got.column("part")[0].as_py(), *packed.merged(got, 3, shared.value))

    def every(got: pa.Table) -> pa.Table:
        ids = np.zeros((got.num_rows, 3), np.int64)
        ids[:, 2] = np.arange(got.num_rows)
        names = got.column("word").combine_chunks()
        ids[:, :2] = pc.sort_indices(names).to_numpy()[:1]  # the context's number is 0
        return _listed(n2 + n1, ids, got.column("freq").to_numpy(), names)

    rows = packed.dealt(train, 2, combine, known).groupBy("part").applyInArrow(collected, TABLE)
    words = vocab.frequencies(train).withColumn("part", F.lit(n2 + n1)).groupBy("part").applyInArrow(every, TABLE)  # a row for each word
    return cut_by(rows.unionByName(words), "part", n2 + n1 + 1), n2, n1


def _step(chains: pa.Table, table: pa.Table) -> pa.Table:
    """Chains of a part, moved on by a word where their context is known, or sent on to the shorter context."""
    n = chains.num_rows
    col = {c: chains.column(c).combine_chunks() for c in chains.column_names}
    length, backed = col["len"].to_numpy(), col["backed"].to_numpy()
    have, place = np.zeros(n, bool), np.zeros(n, np.int64)
    words, following = pa.array([], pa.string()), np.zeros(0, np.int64)
    if n and table.num_rows:
        words = packed.words_of(table.column("words")[0].as_py())
        pairs = _numbers(_unpack(table.column("contexts")[0].as_py()), 2).astype(np.int64)
        sizes, following, times = (_numbers(_unpack(table.column(c)[0].as_py()), 1)[:, 0].astype(np.int64) for c in ("sizes", "next", "times"))
        first, ends = np.cumsum(sizes) - sizes, np.cumsum(times)
        b = pc.fill_null(pc.index_in(col["b"], words), -1).to_numpy()
        a = np.where(length == 2, pc.fill_null(pc.index_in(col["a"], words), -1).to_numpy(), b)
        a, b = np.where(length == 0, 0, a).astype(np.int64), np.where(length == 0, 0, b).astype(np.int64)
        known, asked = pairs[:, 0] * len(words) + pairs[:, 1], a * len(words) + b
        at = np.minimum(np.searchsorted(known, asked), max(0, len(known) - 1))
        have = (a >= 0) & (b >= 0) & (known[at] == asked) if len(known) else have
        before = np.where(first[at] > 0, ends[first[at] - 1], 0)
        total = ends[first[at] + sizes[at] - 1] - before
        place = np.searchsorted(ends, before + np.floor(col["u"].to_numpy() * total).astype(np.int64), "right")
    word = words.take(pa.array(np.where(have, place, 0), mask=~have)) if not len(following) else words.take(pa.array(following[np.where(have, place, 0)], mask=~have))
    text = pc.if_else(pc.equal(col["words"], ""), word, pc.binary_join_element_wise(col["words"], word, tokens.MARK))
    moved = pa.array(have)
    out = [col["chain"], pc.if_else(moved, text, col["words"]), pc.if_else(moved, col["b"], col["a"]), pc.if_else(moved, word, col["b"])]
    again = np.where(pc.is_null(col["b"]).to_numpy(zero_copy_only=False), 1, 2)  # how many words the chain has seen then, two at most
    out += [pa.array((backed + (have & (length < 2))).astype(np.int32)), pa.array(np.where(have, again, length - 1).astype(np.int32)), moved]
    return pa.table(out, names=[c.split()[0] for c in STATE.split(", ")])


def drawn(seeds: DataFrame, table: DataFrame, n2: int, n1: int, steps: int = STEPS, seed: int = 0) -> DataFrame:
    """chain, text (the words drawn, with blanks between them) and backed (how many came from fewer than two words).

    seeds: chain, context (array of words, of which the last two count); table, n2 and n1: from `packed_successors`.
    """
    last = lambda k: F.when(F.size("context") >= k, F.element_at("context", F.when(F.size("context") >= k, F.lit(-k)).otherwise(F.lit(None))))
    code = lambda c: F.crc32(F.col(c).cast("binary"))
    now = seeds.select(F.col("chain").cast("long").alias("chain"), F.lit("").alias("words"), last(2).alias("a"), last(1).alias("b"), F.lit(0).alias("backed"), F.least(F.lit(2), F.size("context")).alias("len"))
    part = F.when(F.col("len") == 2, F.pmod(code("a") * 31 + code("b"), F.lit(n2))).when(F.col("len") == 1, n2 + F.pmod(code("b"), F.lit(n1))).otherwise(n2 + n1)
    keep = now.columns
    for step in range(steps):
        u = unit_draw(F.concat_ws(":", F.lit(seed), F.col("chain"), F.lit(step)))
        todo, used, done = now, table, None
        while True:
            rows = todo.withColumn("u", u).withColumn("part", part.cast("int"))
            got = cut(rows.groupBy("part").cogroup(used.groupBy("part")).applyInArrow(_step, STATE))
            moved = got.where("moved").select(*keep)
            done = moved if done is None else done.unionByName(moved)
            todo = got.where("NOT moved AND len >= 0").select(*keep)
            parts = [r.part for r in todo.select(part.cast("int").alias("part")).distinct().collect()]  # as many as the table has at most
            if not parts:
                break
            used = table.where(F.col("part").isin(parts))
        now = done
    return now.select("chain", F.col("words").alias("text"), "backed")
