from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions import vectors as V
from weftline.operators import metrics, ngrams, prefix, sampling, similarity, suffixes, tokens, vocab
from weftline.operators.prefix import running_before
from weftline.plans import catalog

DOCS = "doc_id long, text string, lang string, source string"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)], DOCS)


def literal_round_robin(draws):
    active, left, rr, out = [n for n, _ in draws], dict(draws), 0, []
    while active:
        name = active[rr % len(active)]
        rr += 1
        if not left[name]:
            active.remove(name)
            continue
        left[name] -= 1
        out.append(name)
    return out


def test_round_robin_places():
    rng = random.Random(1)
    for _ in range(300):
        draws = [(f"s{i}", rng.choice([0, 1, 2, 5, 9, 30])) for i in range(rng.randint(1, 7))]
        phases, place = sampling.leavings(np.array([n for _, n in draws])), {}
        for i, (name, n) in enumerate(draws):
            place.update(dict.fromkeys(sampling.places(phases, i, np.arange(n)).tolist(), name))
        assert [place[i] for i in sorted(place)] == literal_round_robin(draws)
        assert sorted(place) == list(range(len(place)))
    assert "".join(n[1] for n in literal_round_robin([("s0", 5), ("s1", 2), ("s2", 7), ("s3", 1)])) == "012301220202022"


def test_round_robin_rows(spark):
    draws = [("a", 4), ("none", 0), ("b", 9), ("c", 1)]
    rows = [(name, k, "x") for name, n in draws for k in range(n)] + [("other", 0, "x"), (None, 0, "x")]
    df = spark.createDataFrame(rows, "name string, nth long, size string").repartition(3)
    got = sampling.round_robin(df, [n for n, _ in draws]).orderBy("place").collect()
    assert [r.name for r in got] == literal_round_robin(draws)
    assert [r.place for r in got] == list(range(14)) and sampling.round_robin(df.limit(0), ["a"]).count() == 0


def test_round_robin_of_very_many_sources():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 40, 100_000)
    phases = sampling.leavings(counts)
    assert sorted(phases["who"].tolist()) == list(range(100_000))
    assert phases["turn"][-1] == counts.sum() - phases["rounds"][-1] + 99_999
    some = rng.choice(100_000, 60, replace=False)
    seen = np.concatenate([sampling.places(phases, int(i), np.arange(counts[i])) for i in some])
    assert len(np.unique(seen)) == len(seen) and seen.max() < counts.sum()


@pytest.mark.parametrize(
    ("n", "want"),
    [(1, []), (2, [(0, 2, 1)]), (10, [(0, 10, 9)]), (513, [(0, 512, 511), (256, 513, 1)]), (1000, [(0, 512, 511), (256, 768, 256), (512, 1000, 232)])],
)
def test_strided(spark, n, want):
    got = spark.range(1).select(F.lit(n).cast("long").alias("n")).select(F.inline(tokens.strided(F.col("n"), 512, 256))).collect()
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("span", [1000, 1 << 62])
def test_running_before_over_ranges(spark, span):
    rng = random.Random(2)
    rows = [(g, i - span // 2, rng.randint(0, 9)) for g in ("a", "b", None) for i in sorted(rng.sample(range(span), 60))]
    df = spark.createDataFrame(rows, "g string, i long, v int")
    got = {(r.g, r.i): r.s for r in running_before(df, "i", F.col("v"), "s", ["g"], rows=16).collect()}
    for g, i, _ in rows:
        assert got[g, i] == sum(v for h, j, v in rows if h == g and j < i)


def test_running_before_with_repeated_orders(spark):
    rng = random.Random(3)
    orders = [5] * 400 + [rng.choice([1, 2, 2**40, -(2**50), None]) for _ in range(200)] + list(range(10, 200))
    rows = [(o, k, rng.randint(1, 5)) for k, o in enumerate(orders)]
    df = spark.createDataFrame(rows, "o long, k long, v int").repartition(3)
    cuts = prefix.bounds(df, "o", 32)
    assert 3 < cuts.count(5) < 16  # the repeated order is several ranges
    parts = prefix.ranged(df, "o", cuts, F.xxhash64("k"), "b").groupBy("b").count()
    assert parts.agg(F.max("count")).first()[0] < 150
    got = running_before(df, "o", F.col("v"), "s", rows=32, tie=F.xxhash64("k")).collect()
    got.sort(key=lambda r: r.s)
    keys = [float("inf") if r.o is None else r.o for r in got]
    assert keys == sorted(keys)
    total = 0
    for r in got:
        assert r.s == total
        total += r.v


def test_stream_blocks_and_contexts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(30)]
    s = tokens.stream(docs(spark, *texts))
    flat = [w for t in texts for w in t.split()]
    assert [r.token for r in tokens.positions(s).orderBy("pos").collect()] == flat
    packed = tokens.packed(s, 16).orderBy("block").collect()
    assert [r.tokens for r in packed] == [flat[k : k + 16] for k in range(0, len(flat) - 15, 16)]
    got = tokens.contexts(s, 3, size=8).orderBy("pos").collect()
    assert [(r.pos, r.context, r.token) for r in got] == [(i, flat[i - 3 : i], flat[i]) for i in range(3, len(flat))]
    assert sum(r.n for r in tokens.clamp(s, 17).collect()) == 17
    parts = tokens.split(s).collect()
    assert sum(len(r.tokens) for r in parts if r.part == "train") == len(flat) * 9 // 10


def test_led_streams_give_the_same_without_a_second_shuffle(spark):
    """Documents of one word and of none, across ranges and the cut of the parts."""
    rng = random.Random(31)
    texts = [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 1, 1, 2, 40]))) for _ in range(9000)]
    d = spark.createDataFrame([(k * 3 % 9001, t) for k, t in enumerate(texts)], "doc_id long, text string")
    flat = [w for _, t in sorted((k * 3 % 9001, t) for k, t in enumerate(texts)) for w in t.split()]
    s = tokens.stream(d, led=True)
    assert len(prefix.bounds(d, "doc_id")) > 0
    v = vocab.top(vocab.frequencies(s), 9)
    ids = {r.word: r.id for r in v.collect()}
    mapped = vocab.mapped_stream(s, v)
    cut = len(flat) * 9 // 10
    for stream, want in ((s, flat), (mapped, [ids.get(w, 0) for w in flat])):
        got = sorted((r.start, r.tokens, r.lead) for r in stream.collect())
        assert [w for _, t, _ in got for w in t] == want
        assert all(lead == want[max(0, start - tokens.LEAD) : start] for start, _, lead in got)
        p = tokens.split(stream)
        for part, own in (("train", want[:cut]), ("test", want[cut:])):
            rows = p.where(f"part = '{part}'")
            for n in (1, 2, 3):
                have = {tuple(r)[:n]: r.cnt for r in ngrams.wide_counts(rows, n).collect()}
                assert have == Counter(tuple(own[k : k + n]) for k in range(len(own) - n + 1))
        assert [(r.pos, r.context, r.token) for r in tokens.contexts(p.where("part = 'test'"), 3).orderBy("pos").collect()] == [(i, own[i - 3 : i], own[i]) for i in range(3, len(own))]
    plans = [x._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") for x in (s, tokens.contexts(mapped, 3))]
    assert plans[0] == plans[1]  # blocks would be one more


def test_chunked_counts_equal_plain_ones_with_one_shuffle_of_pairs(spark):
    rng = random.Random(32)
    texts = [" ".join(rng.choice("abcde") * rng.randint(1, 2) for _ in range(rng.choice([0, 1, 2, 3, 130]))) for _ in range(40)]
    flat = [w for t in texts for w in t.split()]
    for led in (True, False):
        s = tokens.stream(docs(spark, *texts), led=led)
        want = Counter()
        for k in range(1, 5):
            for a, b in zip(flat, flat[k:]):
                want[a, b] += 1
                want[b, a] += 1
        got = ngrams.cooccurrences(s, 4)
        assert {(r.a, r.b): r.cnt for r in got.collect()} == want
        assert {r.a: r.ca for r in ngrams.neighbours(s, 4).collect()} == {a: sum(c for (x, _), c in want.items() if x == a) for a in set(flat)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    led = tokens.stream(docs(spark, *texts), led=True)
    assert {(r.a, r.b): r.cnt for r in ngrams.both_ways(ngrams.unordered(led, 4, chunk=50)).collect()} == want
    grams = {(r.n, r.gram): r.cnt for r in ngrams.string_counts(led, 3, chunk=50).collect()}
    assert grams == Counter((n, " ".join(flat[k : k + n])) for n in (1, 2, 3) for k in range(len(flat) - n + 1))


def test_a_block_of_neighbours_is_searched_in_bounded_room(spark):
    """1,024 queries by 8,192 vectors: all their products at once would take 67 MB, and as much again to round them."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    taken, plain = [], PandasCogroupedOps.applyInArrow
    e = spark.createDataFrame([(k, [float(k), 1.0], 1) for k in range(4)], "vec_id long, embedding array<double>, label int")
    PandasCogroupedOps.applyInArrow = lambda self, f, schema: taken.append(f) or plain(self, f, schema)
    try:
        similarity.nearest(e, e, 2)
    finally:
        PandasCogroupedOps.applyInArrow = plain
    v = np.random.default_rng(1).normal(size=(8192, 64))
    side = lambda n: pa.table({"id": np.arange(n), "v": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 64), pa.array(v[:n].ravel())), "label": pa.array(np.zeros(n, np.int32))})
    a, b = side(1024), side(8192)
    tracemalloc.start()
    got = taken[0](a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 2048 and peak < 30e6


def test_causal_unigram_over_spans_shuffles_no_tokens(spark):
    rng = random.Random(33)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 9, 70]))) for _ in range(40)]
    got = ngrams.causal_unigram(tokens.stream(docs(spark, *texts)), 0.1, 4096, span=64)
    seen, want = Counter(), []
    for i, t in enumerate(texts):
        for w in t.split():
            want.append((len(want), i, round((seen[w] + 0.1) / (len(want) + 409.6), 12)))
            seen[w] += 1
    assert sorted((r.pos, r.doc_id, round(r.p, 12)) for r in got.collect()) == want
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert all("token" not in x or "part" in x for x in windows)


def literal_suffix(train, ctx, y, most):
    for n in range(min(most, len(ctx)), 0, -1):
        pat = ctx[len(ctx) - n :]
        nxt = [train[i + n] for i in range(len(train) - n) if train[i : i + n] == pat]
        if nxt:
            return n, len(nxt), nxt.count(y), (nxt.count(y) + 1e-6) / (len(nxt) + 1e-6 * 65536)
    return 0, 0, 0, 1 / 65536


def test_longest_suffix_against_backoff(spark):
    rng = random.Random(4)
    flat = [rng.choice("abcd") if rng.random() < 0.8 else f"{rng.choice('xy')}{'z' * rng.randint(1, 60)}" for _ in range(700)]
    flat[629] = "end"  # known at the end of the train part alone
    flat[650] = "end"
    s = tokens.stream(docs(spark, " ".join(flat)))
    p = tokens.split(s)
    got = suffixes.longest_suffix(p.where("part = 'train'"), p.where("part = 'test'"), 4).orderBy("pos").collect()
    train, test = flat[:630], flat[630:]
    seen = {}
    for r in got:
        want = literal_suffix(train, test[max(0, r.pos - 4) : r.pos], test[r.pos], 4)
        assert (r.matched, r.tot, r.yes) == want[:3] and math.isclose(r.p, want[3])
        seen[r.matched] = seen.get(r.matched, 0) + 1
    assert len(got) == 70 and seen[0] > 1 and all(seen.get(n, 0) > 0 for n in (1, 2, 3, 4))
    assert got[21].matched == 0  # behind "end" there is no longer context with a successor


def test_a_stored_index_answers_more_than_one_question(spark, tmp_path):
    """Blocks of a stream of several thousand tokens, one of them in half of all places."""
    rng = random.Random(6)
    flat = ["the" if rng.random() < 0.5 else rng.choice("abcdefghij") for _ in range(11_000)]
    flat[10_000:10_040] = flat[4_080:4_120]  # across two blocks
    s = tokens.stream(docs(spark, *[" ".join(flat[k : k + 700]) for k in range(0, 11_000, 700)]))
    p = tokens.split(s)
    for name in ("train", "test"):
        suffixes.write_index(p.where(f"part = '{name}'"), f"{tmp_path}/{name}")
    train, test = flat[:9_900], flat[9_900:]
    places = {}
    for i in range(len(train)):
        for n in range(1, 17):
            if i + n < len(train):
                places.setdefault(tuple(train[i : i + n]), []).append(train[i + n])
    for most in (2, 16):
        got = suffixes.longest(*[suffixes.index(spark, f"{tmp_path}/{name}") for name in ("train", "test")], most).orderBy("pos").collect()
        assert len(got) == 1100
        for r in got:
            known = [n for n in range(1, most + 1) if n <= r.pos and tuple(test[r.pos - n : r.pos]) in places]
            after = places[tuple(test[r.pos - max(known) : r.pos])] if known else []
            assert (r.matched, r.tot, r.yes, r.y) == (max(known, default=0), len(after), after.count(test[r.pos]), test[r.pos])
    assert max(r.matched for r in got) == 16


def test_full_bit_sets_let_few_unknown_n_grams_pass(spark):
    """Sets with a quarter of their bits: 9 lengths of unknown n-grams send less than one row for each train token; led streams give the same as blocks."""
    rng = random.Random(8)
    train = spark.createDataFrame([(k, " ".join(f"{rng.getrandbits(40):x}".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(100))) for k in range(40)], "doc_id long, text string")
    s = tokens.stream(train, led=True)
    quarter = np.full(1 << 12, 0b10001000, np.uint8)
    rows = suffixes.counted(suffixes.led_index(s), [(1, 8, quarter), (9, 17, quarter)], -1)
    assert rows.count() < 100  # 4,000 tokens; without the shorter lengths' bits about 9,000 rows
    assert 1000 < suffixes.counted(suffixes.led_index(s), [(1, 8, quarter)], -1).count() < 2000
    words = [rng.choice("abcde") for _ in range(3000)]
    s = tokens.stream(docs(spark, *[" ".join(words[k : k + 7]) for k in range(0, 3000, 7)]), led=True)
    both = [sorted(map(tuple, suffixes.longest_suffix(*[p.where(f"part = '{x}'") for x in ("train", "test")], 9).collect())) for p in (tokens.split(s), tokens.split(s.drop("lead")))]
    assert both[0] == both[1] and len(both[0]) == 300


def test_registered_longest_suffix_looks_up_16_tokens(spark, tmp_path):
    rng = random.Random(5)
    flat = [rng.choice("abcdef") for _ in range(600)]
    for to, at, n in ((550, 100, 9), (565, 200, 16), (585, 300, 15)):  # 16 is the most, and what follows is longer than that
        flat[to : to + n] = flat[at : at + n]
    spark.createDataFrame([(0, " ".join(flat))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.infini_gram(spark, str(tmp_path)).orderBy("pos").collect()
    train, test = flat[:540], flat[540:]
    want = [literal_suffix(train, test[max(0, i - 16) : i], test[i], 16) for i in range(60)]
    assert [(r.matched, r.tot, r.yes, r.y) for r in got] == [(*w[:3], y) for w, y in zip(want, test, strict=True)]
    assert all(math.isclose(r.p, w[3], abs_tol=1e-12) for r, w in zip(got, want, strict=True)) and {9, 15, 16} <= {r.matched for r in got}
    words = {w: train.count(w) for w in set(train)}
    base = [(words[y] + 0.05) / (len(train) + 0.05 * 65536) for y in test]
    for r in catalog.lambda_sweep(spark, str(tmp_path)).collect():
        logs = [-math.log((1 - r["lambda"]) * b + r["lambda"] * w[3] + 1e-30) for b, w in zip(base, want, strict=True)]
        assert r.n == 60 and math.isclose(r.ppl, math.exp(sum(logs) / 60), rel_tol=1e-6)


def test_cooccurrence(spark):
    flat = "a b a c d a b b e a".split()
    got = {(r.a, r.b): r.cnt for r in ngrams.cooccurrences(tokens.stream(docs(spark, "a b a c", "d a b b e a")), 2).collect()}
    want = {}
    for i, x in enumerate(flat):
        for d in (1, 2):
            if i >= d:
                want[x, flat[i - d]] = want.get((x, flat[i - d]), 0) + 1
                want[flat[i - d], x] = want.get((flat[i - d], x), 0) + 1
    assert got == want


def test_suffix_ranks(spark):
    flat = list("abracadabra") * 2 + list("mississippi")
    got = {r.pos: r["rank"] for r in ngrams.suffix_ranks(tokens.stream(docs(spark, " ".join(flat))), 4).collect()}
    key = {i: flat[i : i + 16] for i in range(len(flat))}
    order = {tuple(k): n + 1 for n, k in enumerate(sorted({tuple(k) for k in key.values()}))}
    assert got == {i: order[tuple(k)] for i, k in key.items()}


def test_registered_suffix_ranks_sort_by_16_tokens(spark, tmp_path):
    rng = random.Random(6)
    once = [rng.choice("abc") for _ in range(12)]
    flat = [*once, "d", *once, "b", *once, "c", *once]  # alike for 12 tokens, then parted
    spark.createDataFrame([(0, " ".join(flat))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.pos: r["rank"] for r in catalog.suffix_ranks(spark, str(tmp_path)).collect()}
    key = [tuple(flat[i : i + 16]) for i in range(len(flat))]
    order = {k: n + 1 for n, k in enumerate(sorted(set(key)))}
    assert got == {i: order[k] for i, k in enumerate(key)}


def test_words_and_strip(spark):
    df = spark.createDataFrame([("Café It's Kb",), (None,), ("",)], "t string")
    assert [r.w for r in df.select(X.words(F.col("t")).alias("w")).collect()] == [["caf", "it", "s", "b"], [], []]
    odd = ["\t a\n", "\u0085a\x1c", "​a", "﻿a ", "　a ", "  ", "a"]
    df = spark.createDataFrame([(i, o) for i, o in enumerate(odd)], "i int, t string")
    assert [r.s for r in df.orderBy("i").select(X.strip(F.col("t")).alias("s")).collect()] == [o.strip() for o in odd]


def test_md5_mod(spark):
    texts = ["", "a", "hé", "x" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for mod in (500, 10):
        got = [r.m for r in df.select(X.md5_mod(F.col("t"), mod).alias("m")).collect()]
        assert got == [int(hashlib.md5(t.encode()).hexdigest(), 16) % mod for t in texts]
    assert int(hashlib.md5(b"").hexdigest(), 16) % 500 == 366


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 0.0],)], "v array<double>")
    r = df.select(V.argmax(F.col("v")).alias("a"), V.winners(F.col("v"), 1).alias("w"), V.top_margins(F.col("v"), 2).alias("m"), V.logsumexp(F.col("v")).alias("l"), V.softmax(F.col("v")).alias("s"), V.unit(F.array(F.lit(0.0))).alias("z")).first()
    assert r.a == 1 and r.w == [0, 1, 1, 0] and [(x.idx, x.margin) for x in r.m] == [(1, 2.0), (2, 2.0)] and r.z is None
    assert math.isclose(r.l, math.log(math.e + 2 * math.e**3 + 1)) and math.isclose(sum(r.s), 1)


def test_knn_votes_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    rows = [(i, [float(v) for v in x[i]], int(i % 3)) for i in range(60)] + [(99, [0.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    near = similarity.nearest(df.where("vec_id < 10"), df.where("vec_id >= 10"), 5).collect()
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in range(10):
        want = sorted(range(10, 60), key=lambda i: (-round(float(u[q] @ u[i]), 12), i))[:5]
        assert [r.id for r in sorted((r for r in near if r.query_id == q), key=lambda r: r["rank"])] == want
    n = 60
    s = u.sum(0)
    got = similarity.mean_overlap(df).first()
    assert got.n == n and math.isclose(got.overlap, (s @ s - n) / (n * (n - 1)), abs_tol=1e-8)


def test_metrics_edge_cases(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label int, pred int")
    got = {r["class"]: r for r in metrics.per_class(rows, spark.createDataFrame([(0,), (1,), (2,)], "class int")).collect()}
    assert got[2].support == 0 and got[2].f1 == 0 and got[0].recall == 0.5 and got[1].precision == 0.5
    for counts, want in (([0, 0], 0.0), ([1, 1, 1], 0.0), ([0, 0, 3], 2 / 3)):
        df = spark.createDataFrame([(c,) for c in counts], "count long")
        assert math.isclose(metrics.gini(df).first().gini, want, abs_tol=1e-8)
    empty = metrics.gini(spark.createDataFrame([], "count long")).first()
    assert empty.gini == 0 and empty.units == 0
    tie = spark.createDataFrame([(1, 4, 0.5), (1, 2, 0.5)], "query_id long, label int, p double")
    assert similarity.predictions(tie).first().pred == 2
    top = metrics.topk(tie, spark.createDataFrame([(1, 4)], "query_id long, label int")).first()
    assert top.top1 == 1.0


def test_quota_and_weights(spark):
    src = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("gone", 9.0)], "name string, weight double")
    d = spark.createDataFrame([("a", i, "x" * 40) for i in range(5)] + [("b", i, None if i == 1 else "y" * 3) for i in range(4)], "name string, seq long, text string")
    quota = sampling.weights(src, d, 10)
    assert {r.name: (r.weight, r.quota) for r in quota.collect()} == {"a": (0.25, 2), "b": (0.75, 8)}  # 2.5 and 7.5 round to even
    got = sampling.quota_sample(d, quota)
    assert {(r.name, r.seq) for r in got.collect()} == {("a", 0), ("b", 0), ("b", 1), ("b", 2), ("b", 3)}


def test_capped_split_is_disjoint(spark):
    held = spark.createDataFrame([(i, i % 2 == 0) for i in range(10)], "conv_id long, held_out boolean")
    got = {r.conv_id: r.part for r in sampling.capped_split(held, "conv_id", 2).collect()}
    assert [got[i] for i in range(10)] == ["eval", "train", "eval", "train", "none", "train", "none", "train", "none", "train"]


def test_vocab(spark):
    s = tokens.stream(docs(spark, "b a b c", "a d"))
    v = vocab.top(vocab.frequencies(s), 2)
    assert [(r.id, r.word, r.freq) for r in v.orderBy("id").collect()] == [(1, "a", 2), (2, "b", 2)]
    assert [r.id for r in vocab.mapped(s, v).orderBy("pos").collect()] == [2, 1, 2, 0, 1, 0]
    assert [(r["class"], r.slot) for r in vocab.classes(v, 2).orderBy("id").collect()] == [(0, 0), (1, 0)]


def test_weighted_choice_and_negatives(spark):
    r = spark.range(2000).select(sampling.weighted_choice(F.col("id").cast("string"), [("a", 3), ("b", 1)]).alias("c"), sampling.negatives(F.col("id"), F.lit(1), 7).alias("n"))
    rows = r.collect()
    assert 0.7 < sum(x.c == "a" for x in rows) / 2000 < 0.8 and {x.n for x in rows} == set(range(7))


def test_smoothed_series_of_a_long_and_a_short_group(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", i * 977, float(x)) for i, x in enumerate(rng.normal(2.5, 1, 9000))] + [("one", 5, 4.0), ("none", 1, None)]
    got = {r.g: r for r in metrics.smoothed_series(spark.createDataFrame(rows, "g string, o long, v double"), "g", "o", "v").collect()}
    v = np.array([x for g, _, x in rows if g == "hot"])
    ema = v[0]
    for x in v[1:]:
        ema = 0.85 * ema + 0.15 * x
    hot = got["hot"]
    assert (hot.n, hot.best) == (9000, v.min())
    assert abs(hot.ema - ema) < 1e-6 and abs(hot.last10 - v[-10:].mean()) < 1e-6 and abs(hot.sd30 - v[-30:].std()) < 1e-4
    assert tuple(got["one"]) == ("one", 1, 4.0, 4.0, 4.0, 0.0) and "none" not in got


def test_head_to_head_counts_rows_by_their_times(spark):
    rows = spark.createDataFrame([(0.5, 0.1, 3), (0.1, 0.5, 2), (0.2, 0.2, 5)], "a double, b double, m long")
    assert tuple(metrics.head_to_head(rows, "a", "b", times="m").first()) == (10, 3, 2, 5)
    assert tuple(metrics.head_to_head(rows, "a", "b").first()) == (3, 1, 1, 1)
    assert tuple(metrics.head_to_head(rows.limit(0), "a", "b", times="m").first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("led", [True, False])
def test_suffix_ranks_in_many_ranges(spark, led):
    """Chunks of 50 tokens in ranges of 20, one suffix in several: ranks go on from range to range."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "ab", "b", "z" * 15]) for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(30)] + ["a " * 150, "", "ab a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.pos: r["rank"] for r in ngrams.suffix_ranks(tokens.stream(df, led=led), 4, chunk=50, share=20).collect()}
    flat = " ".join(texts).split()
    key = [tuple(flat[i : i + 16]) for i in range(len(flat))]
    order = {k: n + 1 for n, k in enumerate(sorted(set(key)))}
    assert got == {i: order[k] for i, k in enumerate(key)}


def test_suffix_ranks_write_no_round_and_join_no_tokens(spark, sf):
    plan = catalog.suffix_ranks(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "posexplode" not in plan  # rounds were written, with a row for each token


def _word_docs(spark, rng, n=60):
    rows = [(d, " ".join(rng.choice(["a", "b", f"w{'xyz'[d % 3]}", "q" * rng.randint(1, 40)]) for _ in range(rng.randint(0, 30)))) for d in range(n)]
    rows += [(5, "a a b"), (40, "b qq qq")]  # ids that are there again
    return rows, spark.createDataFrame([(d, t.split()) for d, t in rows], "doc_id long, tokens array<string>").repartition(3)


def _brute(rows, cap):
    keys = {}
    for d, t in rows:
        for w in t.split():
            keys.setdefault(w, Counter())[d] += 1
    return keys, {w: sorted(c)[:cap] for w, c in keys.items()}


def test_postings_of_chunks(spark):
    rows, df = _word_docs(spark, random.Random(4))
    keys, first = _brute(rows, 7)
    got = {(r.key, r.doc_id): (r.nth, r.margin) for r in similarity.postings(df, 7, chunk=50).collect()}
    assert got == {(w, d): (n + 1, keys[w][d]) for w, ds in first.items() for n, d in enumerate(ds)}
    late = spark.createDataFrame([(None, ["a"]), (3, ["a", "a"])], "doc_id long, tokens array<string>")
    assert sorted(map(tuple, similarity.postings(late).collect()), key=str) == [("a", 3, 1, 2), ("a", None, 2, 1)]


def test_recall_adds_up_in_blocks_of_queries(spark, monkeypatch):
    """Small blocks and few pairs at a time give what all pairs give, and no pair of a query and a document is shuffled."""
    monkeypatch.setattr(similarity, "ASKED", 40)
    monkeypatch.setattr(similarity, "PAIRS", 50)
    rows, df = _word_docs(spark, random.Random(5))
    keys, first = _brute(rows, 7)
    score, own = {}, Counter()
    for w, ds in first.items():
        for q, m in keys[w].items():
            if q % 4 == 0:
                own[q] += m
                for d in ds:
                    if d != q:
                        score.setdefault(q, Counter())[d] += m
    codes = spark.createDataFrame([(q, w, m) for w, c in keys.items() for q, m in c.items() if q % 4 == 0], "query_id long, key string, margin long").repartition(3)
    index = similarity.postings(df, 7)
    got = similarity.recall(codes, index, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "sum(margin" not in plan.split("FlatMapCoGroupsInArrow")[0]
    want = {(q, n + 1): (d, s) for q, c in score.items() for n, (d, s) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:3])}
    assert {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in got.collect()} == want

    names = [(d, ["en", "de", None][d % 3]) for d in range(0, 60) if d % 7] + [(5, "fr"), (5, "fr")]
    labels = spark.createDataFrame(names, "doc_id long, label string")
    votes, best = {}, {}
    for q, c in score.items():
        for d, s in c.items():
            for name in [x for e, x in names if e == d]:
                votes.setdefault(q, Counter())[name] += (s / own[q]) ** 3
                best[q] = max(best.get(q, 0), s / own[q])
    out = {(r.query_id, r.label): (r.p, r.best) for r in similarity.recalled(codes, index, labels).collect()}
    assert out.keys() == {(q, x) for q, c in votes.items() for x in c}
    for (q, x), (p, b) in out.items():
        assert abs(p - votes[q][x] / sum(votes[q].values())) < 1e-9 and abs(b - best[q]) < 1e-9


def test_recall_without_rows(spark):
    codes = spark.createDataFrame([], "query_id long, key string, margin long")
    index = similarity.postings(spark.createDataFrame([], "doc_id long, tokens array<string>"))
    assert similarity.recall(codes, index, 3).count() == 0
    one = spark.createDataFrame([(1, "a", 2)], "query_id long, key string, margin long")
    assert similarity.recall(one, index, 3).count() == 0
    assert similarity.recalled(one, index, spark.createDataFrame([(1, 7)], "doc_id long, label int")).count() == 0


def test_overlaps_count_every_document(spark, tmp_path, monkeypatch):
    """Documents behind a word's first 48 are found; small blocks, few common words and few sums at a time give the same."""
    rng = random.Random(6)
    rows, _ = _word_docs(spark, rng, 150)
    rows += [(160, "late b b a"), (161, "late b a"), (None, "late a"), (162, None)]
    keys, _ = _brute([r for r in rows if r[0] is not None and r[1]], 0)
    score = {}
    for c in keys.values():
        for query, m in c.items():
            for d in c if query % 20 == 0 else ():
                if d != query:
                    score.setdefault(query, Counter())[d] += m
    want = {(x, n + 1, d, s) for x, c in score.items() for n, (d, s) in enumerate(sorted(c.items(), key=lambda e: (-e[1], e[0]))[:5])}
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert set(map(tuple, catalog.overlap_recall(spark, str(tmp_path)).collect())) == want
    for name, value in (("SIDE", (3, 200)), ("HELD", 300), ("CELLS", 40), ("COMMON", 2)):
        monkeypatch.setattr(similarity, name, value)
    assert set(map(tuple, catalog.overlap_recall(spark, str(tmp_path)).collect())) == want


def _spread(spark, monkeypatch):
    from weftline.operators import packed

    monkeypatch.setattr(packed.frequent, "__defaults__", (3,))  # few words have a number in all tasks, so most pairs are of two others
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["the", "of", "q", "z" * rng.randint(1, 6), "ab" * rng.randint(1, 4)]) for _ in range(rng.choice([1, 2, 30]))) for _ in range(40)]
    flat, want = " ".join(texts).split(), Counter()
    for k in range(1, 5):
        for x, y in zip(flat, flat[k:], strict=False):
            want[x, y] += 1
            want[y, x] += 1
    led = tokens.stream(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), led=True)
    return led, want


def test_pairs_are_shuffled_as_packed_rows(spark, monkeypatch):
    """A chunk sends a row to each part, not one for each pair; pairs of words that no task knows beforehand are counted too."""
    led, want = _spread(spark, monkeypatch)
    assert {(r.a, r.b): r.cnt for r in ngrams.cooccurrences(led, 4).collect()} == want
    rows, known, parts = ngrams._pairs(led, 4, 10**6)
    assert len(known) == 3 and rows.count() <= 2 * parts * led.rdd.getNumPartitions() and rows.count() < len(want)
    plan = ngrams.cooccurrences(led, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "times" in plan and "kind" not in plan


def test_positive_pmi_joins_only_pairs_of_rare_words(spark, monkeypatch):
    led, want = _spread(spark, monkeypatch)
    each, total = Counter(), sum(want.values())
    for (a, _), c in want.items():
        each[a] += c
    pmi = {(a, b): math.log(c * total / (each[a] * each[b])) for (a, b), c in want.items()}
    got = {(r.a, r.b): (r.cnt, r.pmi) for r in ngrams.positive_pmi(led, 4, ngrams.neighbours(led, 4)).collect()}
    assert got.keys() == {k for k, p in pmi.items() if p > 0}
    assert all(c == want[k] and abs(p - pmi[k]) < 1e-9 for k, (c, p) in got.items())


def test_suffix_ranks_read_the_texts_for_one_stored_stream(spark, sf):
    plan = catalog.suffix_ranks(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "documents" not in plan  # counts, samples and packs read the stored stream


def test_documents_of_a_block_ask_once(spark, tmp_path):
    """Equal n-grams of many short documents are one question of their block; what was found is not kept as a checkpoint."""
    s = tokens.stream(spark.createDataFrame([(k, "a b") for k in range(100)], "doc_id long, text string").repartition(3), led=True)
    test = suffixes.asked_index(s, f"{tmp_path}/asked")
    assert suffixes.asked(test, 1, 2, None).count() == 4  # a, b, a b and b a
    assert suffixes.asked(suffixes.asked_index(s, f"{tmp_path}/small", size=50), 1, 2, None).count() == 16
    s.write.parquet(f"{tmp_path}/s")
    s = spark.read.schema(s.schema).parquet(f"{tmp_path}/s")
    got = suffixes.longest_suffix(s, s)
    assert "LogicalRDD" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.pos: (r.y, r.matched) for r in got.collect()}
    assert rows == {k: ("ab"[k % 2], min(k, 16)) for k in range(200)}
