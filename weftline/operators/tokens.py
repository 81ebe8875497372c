"""Token streams: positions, budgets, packing, windows, shards and splits.

A stream has one row for each document: its tokens as an array, and the position in the whole stream of the first.
Blocks are cut out of these arrays as slices, so what is shuffled is slices, not single tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from .prefix import running_before

BLOCK = 4096
LEAD = 17  # words before a document that a led stream has beside it
MARK = " "  # between words that travel as one string; no word has it


def stream(docs: DataFrame, separator: str | None = None, tokens: Column | None = None, led: bool = False) -> DataFrame:
    """doc_id, tokens, n, start; with a separator after each document if one is given. Documents are in the order of doc_id; those that share one, in that of a hash of their tokens.

    Words travel as one string for each document, which takes less room than an array. With `led`, documents without words are
    left out and `lead` has the last LEAD words before each document, so that n-grams need no second shuffle.
    """
    if tokens is not None or (separator is not None and (separator == "" or MARK in separator)):
        if led:
            raise ValueError("only streams of words can be led")
        t = words(F.col("text")) if tokens is None else tokens
        t = t if separator is None else F.concat(t, F.array(F.lit(separator)))
        rows = docs.select("doc_id", t.alias("tokens")).withColumn("n", F.size("tokens").cast("long"))
        return running_before(rows, "doc_id", F.col("n"), "start", tie=F.xxhash64("tokens"))
    t = words(F.col("text"))
    if separator is not None:
        t = F.concat(t, F.array(F.lit(separator)))
    rows = docs.select("doc_id", t.alias("t")).select("doc_id", F.array_join("t", MARK).alias("t"), F.size("t").cast("long").alias("n"))
    got = running_before(rows.where("n > 0") if led else rows, "doc_id", F.col("n"), "start", tie=F.xxhash64("t"), tail=F.substring_index("t", MARK, -LEAD) if led else None, spread=docs.select("doc_id"))
    array = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, MARK))
    out = got.select("doc_id", F.when(F.col("n") > 0, F.split("t", MARK)).otherwise(F.array().cast("array<string>")).alias("tokens"), "n", "start", *(["tail"] if led else []))
    if not led:
        return out
    last = F.substring_index(F.array_join(F.filter("tail", lambda x: x != ""), MARK), MARK, -LEAD)
    return out.withColumn("lead", array(last)).drop("tail")


def positions(s: DataFrame) -> DataFrame:
    """pos, doc_id, token of each token of a stream."""
    return s.select("doc_id", "start", F.posexplode("tokens").alias("i", "token")).select((F.col("start") + F.col("i")).alias("pos"), "doc_id", "token")


def length(s: DataFrame) -> DataFrame:
    """One row: the stream's length as total."""
    return s.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def clamp(s: DataFrame, budget: int) -> DataFrame:
    """The stream's first `budget` tokens; a document that crosses the end is cut."""
    keep = F.greatest(F.least(F.col("n"), F.lit(budget) - F.col("start")), F.lit(0))
    return s.where(F.col("start") < budget).withColumn("n", keep).withColumn("tokens", F.slice("tokens", F.lit(1), F.col("n").cast("int")))


def blocks(s: DataFrame, size: int = BLOCK, before: int = 0, after: int = 0) -> DataFrame:
    """block, first (position of the first token in it) and tokens: of positions block * size - before up to (block + 1) * size + after."""
    first = F.floor((F.col("start") - after) / size)
    last = F.floor((F.col("start") + F.col("n") - 1 + before) / size)
    rows = s.where("n > 0").select("start", "n", "tokens", F.explode(F.sequence(F.greatest(F.lit(0), first).cast("long"), last.cast("long"))).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * size - before)
    hi = F.least(F.col("start") + F.col("n"), (F.col("block") + 1) * size + after)
    part = F.struct(lo.alias("at"), F.slice("tokens", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("t"))
    got = rows.where(hi > lo).groupBy("block").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return got.select("block", F.element_at("parts", 1)["at"].alias("first"), F.flatten(F.transform("parts", lambda p: p["t"])).alias("tokens"))


def packed(s: DataFrame, size: int) -> DataFrame:
    """block, tokens: fixed-length blocks; the stream's rest is dropped."""
    return blocks(s, size).where(F.size("tokens") == size).select("block", "tokens")


def with_lead(s: DataFrame, before: int) -> DataFrame:
    """The rows of a led stream with `all`: at most `before` tokens before the row's own, then its own."""
    own = F.least(F.lit(before), F.size("lead"))
    return s.withColumn("all", F.concat(F.slice("lead", F.size("lead") - own + 1, own), F.col("tokens")))


def contexts(s: DataFrame, context: int, size: int = BLOCK) -> DataFrame:
    """pos, context (the tokens before), token: for each position with that many tokens before it; of a led stream without a shuffle."""
    if "lead" in s.columns and context <= LEAD:
        b = with_lead(s.where("n > 0"), context).select((F.col("start") + F.col("n") - F.size("all")).alias("first"), F.col("all").alias("tokens"), F.lit(context).alias("low"))
    else:
        b = blocks(s, size, before=context)
        # places in the block's array whose position is in the block itself and has a whole context
        b = b.select("first", "tokens", F.greatest(F.lit(context), F.col("block") * size - F.col("first")).cast("int").alias("low"))
    low = F.col("low")
    at = F.when(F.size("tokens") > low, F.sequence(low, F.size("tokens") - 1)).otherwise(F.array().cast("array<int>"))
    row = F.transform(at, lambda i: F.struct((F.col("first") + i).alias("pos"), F.slice("tokens", i - context + 1, context).alias("context"), F.element_at("tokens", i + 1).alias("token")))
    return b.select(F.inline(row))


def strided(n: Column, window: int, stride: int) -> Column:
    """Windows over n tokens as an array of (begin, end, scored): each scores the targets that the one before did not."""
    starts = F.when(n >= 2, F.sequence(F.lit(0), (n - 2).cast("long"), F.lit(stride))).otherwise(F.array().cast("array<bigint>"))
    used = F.filter(starts, lambda b: (b == 0) | (b - stride + window < n))
    return F.transform(used, lambda b: F.struct(b.alias("begin"), F.least(b + window, n).alias("end"), (F.least(b + window, n) - F.when(b == 0, 1).otherwise(b - stride + window)).alias("scored")))


def shards(n: Column, world: int, span: int) -> Column:
    """Contiguous ranges of start positions of each rank, as an array of (rank, lo, hi); a tiny stream gives each the whole."""

    def one(r: Column) -> Column:
        lo, hi = F.floor(r * n / world), F.floor((r + 1) * n / world) - span
        tiny = hi <= lo
        return F.struct(r.alias("rank"), F.when(tiny, 0).otherwise(lo).cast("long").alias("lo"), F.when(tiny, F.greatest(F.lit(1), n - span)).otherwise(hi).cast("long").alias("hi"))

    return F.transform(F.sequence(F.lit(0), F.lit(world - 1)), one)


def split(s: DataFrame, numerator: int = 9, denominator: int = 10) -> DataFrame:
    """The stream cut at floor(total * 9 / 10): rows of (part, start, tokens), with positions from 0 in each part; what leads is of the same part."""
    total = F.broadcast(length(s).select(F.floor(F.col("total") * numerator / denominator).cast("long").alias("cut")))
    rows = s.crossJoin(total)
    head = F.least(F.greatest(F.col("cut") - F.col("start"), F.lit(0)), F.col("n")).cast("int")
    start = F.greatest(F.col("start") - F.col("cut"), F.lit(0))
    led = "lead" in s.columns
    kept = F.least(start, F.size("lead")).cast("int") if led else F.lit(0)
    train = rows.where(head > 0).select(F.lit("train").alias("part"), "doc_id", "start", F.slice("tokens", F.lit(1), head).alias("tokens"), *(["lead"] if led else []))
    test = rows.where(head < F.col("n")).select(F.lit("test").alias("part"), "doc_id", start.alias("start"), F.slice("tokens", head + 1, F.col("n").cast("int") - head).alias("tokens"), *([F.slice("lead", F.size("lead") - kept + 1, kept).alias("lead")] if led else []))
    return train.unionByName(test).withColumn("n", F.size("tokens").cast("long"))
