"""Models that learn, and files in ranges, against plain Python and numpy."""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import classmodel, generation, learners, metrics, packed, relay, sampling, scoring, tokens, vocab
from weftline.operators.lineage import cut
from weftline.plans import catalog, models  # noqa: F401
from weftline.sources import readers, records
from weftline.streaming import incremental, learning

# ---- files of records


def test_ranges_read_as_one(spark, tmp_path):
    rng = np.random.default_rng(1)
    sizes = {"b.bin": 1000, "a.bin": 37, "c.bin": 0, "d.bin": 5000}
    data = {n: rng.integers(0, 2**32, k).astype("<u4") for n, k in sizes.items()}
    for n, x in data.items():
        (tmp_path / n).write_bytes(x.tobytes() + b"\x01" * (n == "b.bin"))
    (tmp_path / "meta.json").write_text("{}")
    want = np.concatenate([data[n] for n in sorted(data)]).tolist()
    for span in (4, 1000, 1 << 20):
        got = readers.token_files(spark, str(tmp_path), range_bytes=max(span, 64))
        rows = got.orderBy("id").collect()
        assert [r.id for r in rows] == list(range(len(want))) and [r.token for r in rows] == want
        assert [r.pos for r in rows[:38]] == [*range(37), 0]
    assert readers.token_files(spark, str(tmp_path), range_bytes=64).rdd.getNumPartitions() > 300
    assert readers.token_files(spark, str(tmp_path / "[ab].bin")).count() == 1037
    assert readers.token_files(spark, str(tmp_path / "c.bin")).count() == 0
    with pytest.raises(Exception, match="nothing.bin"):
        readers.token_files(spark, str(tmp_path / "nothing.bin")).count()


def test_images_of_several_files_have_their_own_ids(spark, tmp_path):
    for n, k in (("x1.u8", 50), ("x2.u8", 30)):
        (tmp_path / n).write_bytes(bytes(i % 256 for i in range(k * 4)))
        (tmp_path / n.replace("x", "y")).write_bytes(bytes(i % 10 for i in range(k)))
    got = readers.images(spark, str(tmp_path / "x*.u8"), 4, range_bytes=40).join(readers.labels(spark, str(tmp_path / "y*.u8"), range_bytes=7), "id").orderBy("id").collect()
    assert [r.id for r in got] == list(range(80))
    assert [r.label for r in got] == [*[i % 10 for i in range(50)], *[i % 10 for i in range(30)]]
    assert [round(v * 255) for v in got[51].x] == [4, 5, 6, 7]
    (tmp_path / "x3.u8").write_bytes(b"abc")
    with pytest.raises(Exception, match="no multiple"):
        readers.images(spark, str(tmp_path / "x*.u8"), 4).count()


def test_token_files_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(k * 100, list(range(k * 100, k * 100 + 100))) for k in range(40)] + [(4000, [7])], "start long, tokens array<int>").repartition(7)
    out = str(tmp_path / "t")
    for _ in range(2):  # writing again replaces
        records.write_tokens(s, out, "uint16", parts=5)
    rows = readers.token_files(spark, f"{out}/*.bin", "uint16", range_bytes=128).orderBy("id").collect()
    assert [r.token for r in rows] == [*range(4000), 7]
    assert json.loads((tmp_path / "t" / "meta.json").read_text()) == {"n_tokens": 4001, "dtype": "uint16"}
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("_")]
    with pytest.raises(Exception, match="beyond"):
        records.write_tokens(s, out, "uint8")
    assert readers.token_files(spark, f"{out}/*.bin", "uint16").count() == 4001  # what failed left the old files as they were


# ---- predict, then learn


def literal_learning(words, size):
    pairs, before, after, mix, out = Counter(), Counter(), Counter(), [0.0] * 3, []
    cases = list(zip(words[:-1], words[1:], strict=True))
    for lo in range(0, len(cases), size):
        w = [math.exp(m) / sum(map(math.exp, mix)) for m in mix]
        ps = [(1 / 4096, (after[y] + 0.1) / (lo + 409.6), (pairs[x, y] + 0.1) / (before[x] + 409.6)) for x, y in cases[lo : lo + size]]
        mixed = [sum(a * b for a, b in zip(w, p, strict=True)) for p in ps]
        out.append((lo // size, len(ps), -sum(map(math.log, mixed)), -sum(math.log(p[2]) for p in ps), w[2]))
        if len(ps) == size:
            mix = [m + 0.05 * (sum(a * p[k] / q for p, q in zip(ps, mixed, strict=True)) / size - a) for k, (m, a) in enumerate(zip(mix, w, strict=True))]
            for x, y in cases[lo : lo + size]:
                pairs[x, y] += 1
                before[x] += 1
                after[y] += 1
    return out


def documents(rng):
    return {i: [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(n)] for i, n in enumerate((0, 1, 2, 17, 64, 65, 200, 333))}


def test_chunks_are_scored_before_they_are_learnt(spark):
    docs = documents(random.Random(1))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, tokens array<string>")
    got = defaultdict(list)
    for r in learning.causal_bigram(df, size=16).orderBy("doc_id", "chunk").collect():
        got[r.doc_id].append((r.chunk, r.n, r.nll))
    for i, words in docs.items():
        want = literal_learning(words, 16)
        assert [(c, n) for c, n, _ in got[i]] == [(c, n) for c, n, *_ in want]
        assert all(abs(a[2] - b[3]) < 1e-3 for a, b in zip(got[i], want, strict=True))


def test_causal_bigram_shuffles_documents_not_words(spark):
    """One exchange, of documents; rows that share an id are learnt from together."""
    df = spark.createDataFrame([(1, ["a", "b", "a", "b", "a"]), (1, ["a", "b", "c"]), (2, ["a"]), (3, [])], "doc_id long, tokens array<string>")
    got = learning.causal_bigram(df, size=2)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.chunk: (r.n, r.nll) for r in got.collect()}
    first = 4 * math.log(4096)
    second = -(math.log((2 + 0.1) / (2 + 409.6)) + math.log((1 + 0.1) / (2 + 409.6)))
    assert rows == {0: (4, round(first, 4)), 1: (2, round(second, 4))}


@pytest.mark.parametrize("waves", [1, 3])
def test_learning_goes_on_from_a_checkpoint(spark, tmp_path, waves):
    rng = random.Random(2)
    docs = documents(rng)
    parts = []
    for i, words in docs.items():
        at, k = 0, 0
        while at < len(words):
            step = rng.choice([1, 5, 16, 40])
            parts.append((i, k, words[at : at + step]))
            at, k = at + step, k + 1
    schema, src, out = "doc_id long, part long, tokens array<string>", tmp_path / "in", str(tmp_path / "out")
    for wave in range(waves):  # each wave is a run of its own, which ends; the next goes on from the checkpoint
        mine = [p for p in parts if min(p[1] * waves // 12, waves - 1) == wave]
        again = [p for p in parts if wave and p[1] == 0]  # sent twice
        spark.createDataFrame(mine + again, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        incremental.run_to_end(learning.learnt(stream, 16), incremental.replace_round(out), str(tmp_path / "cp"), mode="append")
    rows = spark.read.schema(learning.RESULT).parquet(out)
    per = {(r.doc_id, r.chunk): r for r in rows.groupBy("doc_id", "chunk").agg(F.sum("n").alias("n"), F.sum("nll").alias("nll"), F.sum("nll_bigram").alias("b"), F.max("w_bigram").alias("w")).collect()}
    want = {(i, c): v for i, words in docs.items() for c, *v in literal_learning(words, 16)}
    assert set(per) == set(want)
    for key, (n, nll, b, w) in want.items():
        r = per[key]
        assert r.n == n and abs(r.nll - nll) < 1e-6 and abs(r.b - b) < 1e-6 and abs(r.w - w) < 1e-9


# ---- classes and drawn words


def test_class_model_by_hand(spark):
    rng = random.Random(3)
    words = [rng.choice("abcdefghij") for _ in range(600)]
    docs = spark.createDataFrame([(0, " ".join(words[:250])), (1, " ".join(words[250:]))], "doc_id long, text string")
    s = tokens.stream(docs)
    v = vocab.top(vocab.frequencies(s), 8)
    ids = {r.word: r.id for r in v.collect()}
    cls = {r.id: r["class"] for r in vocab.classes(v, 4).collect()} | {0: -1}
    p = tokens.split(cut(vocab.mapped_stream(s, v)))
    train, test = p.where("part = 'train'"), p.where("part = 'test'")
    rows = classmodel.cases(train, test, vocab.classes(v, 4), 4).collect()
    seq = [ids.get(w, 0) for w in words]
    head, tail = seq[:540], seq[540:]
    uni, pair = Counter(head), Counter(zip(head[:-1], head[1:], strict=True))
    per = Counter()
    for i, n in uni.items():
        per[cls[i]] += n
    assert Counter({(r.x, r.y): r.times for r in rows}) == Counter(zip(tail[:-1], tail[1:], strict=True))
    for r in rows:
        cx = sum(n for (a, _), n in pair.items() if a == r.x)
        cxc = sum(n for (a, b), n in pair.items() if a == r.x and cls[b] == cls[r.y])
        size = sum(c == cls[r.y] for c in cls.values())
        assert abs(r.p_class - (cxc + 0.05) / (cx + 0.25)) < 1e-12
        assert abs(r.p_word - (uni[r.y] + 0.05) / (per[cls[r.y]] + 0.05 * size)) < 1e-12
    for c in set(cls.values()):
        total = sum((uni[i] + 0.05) / (per[c] + 0.05 * sum(k == c for k in cls.values())) for i, k in cls.items() if k == c)
        assert abs(total - 1) < 1e-9


def plain_sampler(words, chain, seen, most, steps, temperature, seed=0):
    table = defaultdict(Counter)
    for n in range(most + 1):
        for i in range(n, len(words)):
            table[n, tuple(words[i - n : i])][words[i]] += 1
    seen, out, backed = list(seen), [], 0
    for step in range(steps):
        n = next(k for k in range(most, -1, -1) if k <= len(seen) and (k, tuple(seen[len(seen) - k :])) in table)
        rows = sorted(table[n, tuple(seen[len(seen) - n :])].items(), key=lambda r: (-r[1], r[0]))
        if temperature <= 0:
            word = rows[0][0]
        else:
            top = rows[0][1]
            w = [c if temperature == 1 else max(1, round((c / top) ** (1 / temperature) * 1_000_000)) for _, c in rows]
            u = int(hashlib.md5(f"{seed}:{chain}:{step}".encode()).hexdigest()[:13], 16) / 2**52
            at, k = math.floor(u * sum(w)), 0
            while at >= w[k]:
                at -= w[k]
                k += 1
            word = rows[k][0]
        seen.append(word)
        out.append(word)
        backed += n < most
    return out, backed


@pytest.mark.parametrize("temperature", [1.0, 0.5, 0.0])
def test_words_are_drawn_as_by_a_plain_sampler(spark, temperature):
    rng = random.Random(4)
    words = [rng.choice(["the"] * 8 + [f"w{chr(97 + k)}" for k in range(20)]) for _ in range(400)]
    s = tokens.stream(spark.createDataFrame([(0, " ".join(words))], "doc_id long, text string"))
    table = cut(generation.successors(s, 2, temperature))
    if temperature == 1:  # slots: no more than two rows an interval, in all
        assert table.count() <= 2 * table.select("len", "context", "word").distinct().count()
    seeds = [(k, [rng.choice([*words, "unheard"]) for _ in range(k % 3)]) for k in range(30)]
    got = generation.generated(spark.createDataFrame(seeds, "chain long, context array<string>").repartition(3), table, 2, steps=7, every=3).collect()
    assert len(got) == 30
    for r in got:
        assert (r.words, r.backed) == plain_sampler(words, r.chain, seeds[r.chain][1], 2, 7, temperature)


# ---- classifiers and dictionaries


def labelled(n=600, dim=6, classes=3, seed=5):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(classes, dim))[y] * 2 + rng.normal(size=(n, dim))
    return x, y


def test_softmax_equals_numpy_whatever_the_partitions(spark):
    x, y = labelled()
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    rows += [(900, None, 1), (901, [1.0], 1), (902, [float("nan")] * 6, 1), (903, [0.0] * 6, 7), (904, [0.0] * 6, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    fits = [learners.fit_softmax(df.repartition(k), "v", "y", 6, 3, rounds=12, rate=0.5) for k in (1, 7)]
    assert (fits[0] == fits[1]).all()
    q = np.c_[np.rint(x * 4096), np.full(len(x), 4096)]
    w = np.zeros((7, 3))
    for _ in range(12):
        z = q @ w / 4096
        p = np.exp(z - z.max(1, keepdims=True))
        p = p / p.sum(1, keepdims=True) - np.eye(3)[y]
        w = w - 0.5 * (q.T @ np.rint(p * 2**18)) / 4096 / 2**18 / len(x)
    assert np.abs(w - fits[0]).max() < 1e-9
    got = learners.classified(df, "v", fits[0], "id", "y").collect()
    assert len(got) == 602 and np.mean([r.pred == r.y for r in got]) > 0.9
    assert not learners.fit_softmax(df.limit(0), "v", "y", 6, 3).any()


def test_dictionary_equals_numpy_and_gets_better(spark):
    x, _ = labelled(500, 6, 4, 6)
    x = np.rint(x * 4096) / 4096
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    fits = [learners.fit_dictionary(df.repartition(k), "v", "id", 6, 4, 8, rounds=6) for k in (1, 5)]
    assert (fits[0].words == fits[1].words).all() and (fits[0].projection == fits[1].projection).all()
    own = fits[0]
    assert all(b >= a - 1e-6 for a, b in zip(own.reached, own.reached[1:], strict=False)) and own.reached[-1] > own.reached[0]
    cov = np.cov(x.T, bias=True)
    value, direction = np.linalg.eigh(cov)
    m = direction[:, ::-1][:, :4] / np.sqrt(value[::-1][:4] + 1e-2)
    z = (x - x.mean(0)) @ m
    order = sorted(range(500), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:8]
    c = z[order] / np.linalg.norm(z[order], axis=1, keepdims=True)
    for _ in range(6):
        best = (z @ c.T).argmax(1)
        for k in range(8):
            if (best == k).any():
                c[k] = z[best == k].sum(0) / np.linalg.norm(z[best == k].sum(0))
    match = z @ c.T
    got = {r.id: r for r in learners.encoded(df, "v", "id", 6, own).collect()}
    assert np.mean([got[i].word == match[i].argmax() for i in range(500)]) > 0.99
    assert max(abs(got[i].match - match[i].max()) for i in range(500)) < 1e-3
    assert all(abs(v - max(0, a - match[0].mean())) < 1e-3 for v, a in zip(got[0].code, match[0], strict=True))


def test_codewords_without_vectors_stay(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(20)], "id long, v array<double>")
    own = learners.fit_dictionary(df, "v", "id", 2, 1, 6, rounds=3)
    assert own.words.shape == (6, 1) and np.isfinite(own.words).all()
    assert learners.fit_dictionary(df.limit(0), "v", "id", 2, 1, 6) is None


# ---- scorers


@pytest.mark.parametrize("n", [0, 1, 2, 10, 13, 40])
def test_windows_score_each_target_once(spark, n):
    s = spark.createDataFrame([(0, k, len(range(k, min(n, k + 7))), list(range(k, min(n, k + 7)))) for k in range(0, n, 7)], "doc_id long, start long, n long, tokens array<int>")
    seen = scoring.strided_losses(s, lambda: lambda windows: [-(w[1:].astype(float)) for w in windows], 12, 4).orderBy("begin").collect()
    starts = [b for b in range(0, max(n - 1, 0), 4) if b == 0 or b + 8 < n]
    assert [(r.begin, r.scored) for r in seen] == [(b, min(b + 12, n) - (1 if b == 0 else b + 8)) for b in starts]
    assert sum(r.nll for r in seen) == sum(range(1, n))
    flat = scoring.strided_losses(s, scoring.SCORERS["uniform"](s, size=16), 12, 4)
    assert scoring.perplexity(flat).first().ppl == (None if n < 2 else 16.0)


# ---- relays, series, orders


def test_relays_find_what_is_alike(spark):
    rng = random.Random(7)
    base = [{f"k{rng.randrange(5000)}": rng.randint(1, 4) for _ in range(60)} for _ in range(60)]
    codes = {2 * i: c for i, c in enumerate(base)}
    for i, c in enumerate(base):  # a likeness of each: a few keys replaced
        keep = dict(list(c.items())[rng.randint(0, 4) :])
        codes[2 * i + 1] = keep | {f"n{rng.randrange(5000)}": 1 for _ in range(rng.randint(0, 3))}
    df = spark.createDataFrame([(d, k, m) for d, c in codes.items() for k, m in c.items()], "doc_id long, key string, margin long").repartition(5)
    bits = lambda k: int(hashlib.md5(k.encode()).hexdigest(), 16)

    def vector(c):
        out = np.zeros(128)
        for k, m in c.items():
            words = [(bits(k) >> (96 - 32 * g)) & 0xFFFFFFFF for g in range(4)]
            out += [m if words[j // 32] >> (j % 32) & 1 else -m for j in range(128)]
        return out

    v = {d: vector(c) for d, c in codes.items()}
    for r in relay.relayed(df).collect():
        assert np.allclose(r.relay, v[r.doc_id] * math.sqrt(128) / (np.linalg.norm(v[r.doc_id]) + 1e-6))
    got = relay.near(df, F.col("doc_id") % 2 == 0, 5).collect()
    found = {(r.query_id, r.doc_id): r.cos for r in got}
    for (a, b), c in found.items():
        assert a != b and abs(c - v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])) < 1e-8
    alike = [i for i in range(60) if v[2 * i] @ v[2 * i + 1] / np.linalg.norm(v[2 * i]) / np.linalg.norm(v[2 * i + 1]) > 0.95]
    assert len(alike) > 10 and np.mean([(2 * i, 2 * i + 1) in found for i in alike]) > 0.9


def test_relays_agree_with_overlap(spark, sf):
    best = {r.query_id: r.doc_id for r in catalog.QUERIES["overlap_recall"](spark, sf).where("rank = 1").collect()}
    got = {(r.query_id, r.doc_id) for r in catalog.QUERIES["relay_recall"](spark, sf).where("cos > 0.9").collect()}
    asked = {a for a, _ in got}
    assert asked and np.mean([(a, best[a]) in got for a in asked]) >= 0.9


@pytest.mark.parametrize("size", [4096, 70])
def test_trends_over_parts(spark, size):
    rng = random.Random(9)
    rows = [(g, i * 3, rng.choice([1.0, 2.0, 3.0, None])) for g, n in (("a", 400), ("b", 61), (None, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long, v double").repartition(4)
    got = {(r.g, r.i): r for r in metrics.trends(df, "g", "i", "v", size=size).collect()}
    for g in ("a", "b", None):
        own = [(i, v) for h, i, v in rows if h == g and v is not None]
        for k, (i, v) in enumerate(own):
            last = [x for _, x in own[max(0, k - 59) : k + 1]]
            r = got.pop((g, i))
            assert (r.n, r.best) == (len(last), min(x for _, x in own[: k + 1])) and abs(r.mean - sum(last) / len(last)) < 1e-8
            assert r.trend == ("none" if not k else "down" if v < own[k - 1][1] else "up" if v > own[k - 1][1] else "same")
    assert not got


def test_shuffled_is_a_seeded_permutation(spark):
    df = spark.range(500).withColumnRenamed("id", "i")
    a, b = ([r.i for r in sampling.shuffled(df.repartition(k), "i", 3).orderBy("place").collect()] for k in (1, 6))
    assert a == b and sorted(a) == list(range(500)) and a != sorted(a)
    assert [r.place for r in sampling.shuffled(df, "i", 4).orderBy("place").collect()] == list(range(500))


def test_chains_are_moved_on_alike_with_and_without_sent_contexts(spark, monkeypatch):
    s = tokens.stream(spark.createDataFrame([(k, "a b a c b a b d c") for k in range(3)], "doc_id long, text string"))
    table = cut(generation.successors(s, 2))
    seeds = spark.createDataFrame([(1, ["a", "b"]), (2, ["x"]), (3, ["x", "c"])], "chain long, context array<string>")
    runs = []
    for most in (0, 10):
        monkeypatch.setattr(generation, "MOST_SENT", most)
        runs.append(sorted(map(tuple, generation.generated(seeds, table, 2, steps=2).collect())))
    assert runs[0] == runs[1] and len(runs[0]) == 3


def test_packed_chains_are_drawn_as_joined_ones(spark, monkeypatch):
    """Many small parts, few words that all tasks know, unknown contexts and short seeds; the table is not shuffled again."""
    monkeypatch.setattr(generation, "SHARE", 60)
    monkeypatch.setattr(packed.frequent, "__defaults__", (3,))
    monkeypatch.setattr(packed.dealt, "__defaults__", (50,))
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["a", "b", "c", "z" * rng.randint(1, 9)]) for _ in range(rng.choice([0, 1, 3, 40]))) for _ in range(30)]
    s = tokens.stream(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), led=True)
    seeds = [(k, rng.choice([["a", "b"], ["zz", "c"], ["zzz", "zzzz"], ["nowhere", "a"], ["nowhere"], ["b"], []])) for k in range(200)]
    seeds = spark.createDataFrame(seeds, "chain long, context array<string>").repartition(3)
    table, n2, n1 = generation.packed_successors(s)
    assert n2 > 5
    got = {r.chain: (r.text, r.backed) for r in generation.drawn(seeds, table, n2, n1, steps=6).collect()}
    joined = generation.generated(seeds, cut(generation.successors(s, 2)), 2, steps=6)
    assert got == {r.chain: (" ".join(r.words), r.backed) for r in joined.collect()} and len(got) == 200
    plan = seeds.select(F.lit(1).alias("part"), "chain").groupBy("part").cogroup(table.groupBy("part")).applyInArrow(lambda a, b: a, "part int, chain long")
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the chains alone


def test_relays_meet_in_their_buckets(spark, monkeypatch):
    """Few rows of bands in a task and few products at a time: the same as all pairs, copies too; no pair is shuffled."""
    monkeypatch.setattr(relay, "SHARE", 100)
    monkeypatch.setattr(relay, "PAIRS", 3)
    rng = random.Random(8)
    base = [{f"k{rng.randrange(40)}": rng.randint(1, 3) for _ in range(4)} for _ in range(12)]
    codes = {d: base[d % 12] for d in range(60)}
    df = spark.createDataFrame([(d, k, m) for d, c in codes.items() for k, m in c.items()], "doc_id long, key string, margin long").repartition(5)
    s = {r.doc_id: np.array(r.s) for r in relay.sums(df).collect()}
    want = {}
    for q in range(0, 60, 5):
        cos = {d: round(float(s[q] @ v / np.linalg.norm(s[q]) / np.linalg.norm(v)), 8) for d, v in s.items() if d != q and any(((s[q] >= 0) == (v >= 0))[b * 16 : b * 16 + 16].all() for b in range(8))}
        want |= {(q, n + 1): (d, cos[d]) for n, d in enumerate(sorted(cos, key=lambda d: (-cos[d], d))[:5])}
    got = relay.near(df, F.col("doc_id") % 5 == 0, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin" not in plan
    assert {(r.query_id, r["rank"]): (r.doc_id, round(r.cos, 8)) for r in got.collect()} == want


def test_a_document_is_learnt_without_an_object_for_each_word():
    """The same losses however a document is cut, from states that hold a few bytes for each word."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(300)}" for _ in range(5000)]
    want = literal_learning(words, 256)
    for steps in ([1000], [1], [255, 1, 700], [256], [5000]):
        state, at, k, got = None, 0, 0, defaultdict(lambda: [0, 0.0, 0.0, 0.0])
        while at < len(words):
            own = learning.Learner(state)
            n = steps[k % len(steps)] if k < 40 else 5000  # after some parts the rest at once
            for _, c, m, nll, _, big, *w in own.read([(k, words[at : at + n])], 256):
                g = got[c]
                g[0], g[1], g[2], g[3] = g[0] + m, g[1] + nll, g[2] + big, w[2]
            state, at, k = own.state(), at + n, k + 1
        assert [(c, *got[c]) for c in sorted(got)] == [(c, n, pytest.approx(a), pytest.approx(b), pytest.approx(w)) for c, n, a, b, w in want]
    assert len(state) == 6 and len(state[3]) < 8 * len(words)  # was three values of Python for each different pair
