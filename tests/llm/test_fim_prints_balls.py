"""Fill-in-middle, one-permutation fingerprints and ball-tree clustering against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import balltree, infill, oneperm

SCHEMA = "doc_id long, text string"
BITS = ["a", "word", " ", "  ", "\n", "\t", "é", "日本", "\U0001f600", "́", "<", ">", "<P", "S>", "<M", "P>", "x" * 40, " ", "0", "_"]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    made = ["".join(rng.choice(BITS) for _ in range(rng.choice([1, 2, 5, 30, 200]))) for _ in range(n)]
    return [*made, None, "", " ", "<P>", "a<S>b", "x<M>", "<", "one two three", "w " * 300_000, "é" * 100_000, made[0], made[0]]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill in middle


def plain_fim(doc_id, text, seed=1, marks=infill.MARKS, rate=90, spm=20):
    parts = list(text or "")
    text = text or ""
    n = len(parts)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not n or any(m in text for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), marks[1] + suf + marks[0] + pre + marks[2] + mid
    return n, "psm", len(pre), len(mid), marks[0] + pre + marks[1] + suf + marks[2] + mid


@pytest.mark.parametrize("options", [{}, {"seed": 7, "rate": 100, "spm": 50, "marks": ("<|pre|>", "[s", "é→")}])
def test_fim_against_plain_python(spark, options):
    texts = odd_texts(400)
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    src = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, output int").repartition(3)
    src = src.withColumnsRenamed({"output": "place"}).withColumn("form", F.lit("mine")).withColumn("__h0", F.lit(9)).withColumn("__text", F.lit("x"))
    got = infill.restored(infill.infilled(src, keep=("place", "form", "__h0", "__text"), **options), marks=options.get("marks", infill.MARKS)).collect()
    assert len(got) == len(rows) and {r["__h0"] for r in got} == {9}
    for r in got:
        doc_id, text = rows[r.place]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(doc_id, text, **options)
        assert r.restored == (text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_by_words(spark):
    texts = [t for t in odd_texts(300, 8) if t is None or len(t) < 10_000]
    src = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for r in infill.restored(infill.infilled(src, units="words", rate=100)).collect():
        text = texts[r.doc_id] or ""
        assert r.restored == text
        starts = [i for i in range(len(text)) if i == 0 or (text[i - 1] in "\t\n\v\f\r " and text[i] not in "\t\n\v\f\r ")]
        assert r.n == len(starts)
        if r.form != "plain":
            assert {r.prefix_chars, r.prefix_chars + r.middle_chars} <= {*starts, len(text)}


def test_fim_query(spark):
    src = spark.createDataFrame([(5, "some text here", "b", "x"), (5, "some text here", "b", "x"), (None, None, None, None)], "doc_id long, text string, n string, `output sha256` string")
    got = infill.op11(src).collect()
    assert len(got) == 3 and got[0] == got[1]
    n, form, pre, mid, out = plain_fim(5, "some text here")
    assert tuple(got[0]) == (5, n, form, pre, mid, sha(out), sha("some text here"))
    assert infill.op11(spark.createDataFrame([], SCHEMA)).count() == 0


def test_marks_that_cannot_be_found_again():
    for marks in (("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<S>", "<S>", "<M>")):
        with pytest.raises(ValueError, match="mark"):
            infill.checked(marks)
    with pytest.raises(ValueError, match="lacks a mark"):
        infill.back(pa.array(["no mark", "<P>a<S>b<M>c"]), pa.array(["psm", "psm"]))


# ---- fingerprints


def plain_shingles(text):
    words = re.findall(r"[^\W]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = plain_shingles(a), plain_shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize(("bins", "bits"), [(16, 8), (256, 4), (64, 1)])
def test_sketch_against_a_literal_one(bins, bits):
    """Every bin by its definition, in whole numbers of Python."""
    s = oneperm.Sketcher(bins, bits)
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (1, 4, 5, 6, 9, 30, 300, 2000)] + ["", "  ?! "]
    full = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    h, off = oneperm.shingles(pa.array(texts))
    for i, code in enumerate(s.sketch(pa.array(texts))):
        values = {}
        low = 64 - bins.bit_length() + 1
        for x in map(int, h[off[i] : off[i + 1]]):
            values[x >> low] = min(values.get(x >> low, full), x & ((1 << low) - 1))
        if not values:
            assert code == b""
            continue
        stored = 0
        for b in range(bins):
            probe = sorted(range(bins), key=lambda j: mix((b * bins + j) * 0x9E3779B97F4A7C15 + 1 & full))
            v = values[b] if b in values else values[next(j for j in probe if j in values)]
            own = mix(v + b * 0x9E3779B97F4A7C15 & full)
            for k in range(bits):
                stored = stored << 1 | (own >> k & 1)
        assert int.from_bytes(code) == stored


def test_likeness_estimates_similarity():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    s, errors = oneperm.Sketcher(), []
    for share in (0, 0.3, 0.6, 0.8, 0.95, 1):
        for size in (40, 400, 4000):
            a = [rng.choice(words) for _ in range(size)]
            b = a[: int(share * size)] + [rng.choice(words) for _ in range(size - int(share * size))]
            a, b = " ".join(a), " ".join(b)
            codes = s.sketch(pa.array([a, b]))
            errors.append(s.likeness(codes[:1], codes[1:])[0] - jaccard(a, b))
    assert max(map(abs, errors)) < 0.16 and abs(float(np.mean(errors))) < 0.03
    one, two = s.sketch(pa.array(["alone", "other"]))
    assert s.likeness([one, one, b"", b""], [two, one, b"", one]).tolist() == [pytest.approx(0, abs=0.1), 1.0, 1.0, 0.0]


def test_fingerprints_of_neighbours(spark):
    texts = odd_texts(300, 5)
    rows = [(i * 10**15 - 10**17, t) for i, t in enumerate(texts)]
    src = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, part string, fingerprint string").repartition(5)
    got = {r.doc_id: r for r in oneperm.op12(src).collect()}
    assert len(got) == len(rows)
    s = oneperm.Sketcher()
    down = rows[::-1]
    for (i, t), (_, nxt) in zip(down, [*down[1:], down[0]], strict=True):
        t, nxt = t or "", nxt or ""
        n = len(t) // 3
        new = t[: len(t) - n] + nxt[:n]
        codes = s.sketch(pa.array([t, new, nxt]))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), sha(new), codes[0].hex(), codes[1].hex())
        assert (r.near_edited, r.near_next) == tuple(s.likeness([codes[0]] * 2, codes[1:]))


def test_fingerprint_edge_cases(spark):
    assert oneperm.op12(spark.createDataFrame([], SCHEMA)).count() == 0
    one = oneperm.op12(spark.createDataFrame([(1, "a b c d e f g")], SCHEMA)).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(1, 1.0)]
    many = oneperm.op12(spark.createDataFrame([(7, "same words here again and again")] * 40 + [(None, None)] * 30 + [(7, "b")], SCHEMA).repartition(4)).collect()
    assert len(many) == 71 and len({r.fingerprint for r in many}) == 3
    assert sum(r.doc_id is None for r in many) == 30
    kept = oneperm.fingerprinted(spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, n int"), keep=("doc_id", "n")).first()
    assert kept.n == 5 and bytes(kept.fingerprint) == oneperm.Sketcher().sketch(pa.array(["a b"]))[0]


# ---- clustering


def lloyd(rows, k, rounds, dim, scale=64, seed=1):
    """The definition, in whole numbers of Python."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, tuple(int(np.floor(scale * float(np.float32(x)))) for x in v)))
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    c = [x for _, x in order[:k]]

    def near(x):
        d = [sum((a - b) ** 2 for a, b in zip(x, one, strict=True)) for one in c]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [near(x)[0] for _, x in kept]
        for j in range(len(c)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = tuple(sum(col) // len(mine) for col in zip(*mine, strict=True))
    last = [(i, *near(x)) for i, x in kept]
    per = {j: sum(d for _, o, d in last if o == j) for j in range(len(c))}
    return sorted([(i, j, d, per[j], sum(per.values()), sha(",".join(map(str, c[j])))) for i, j, d in last], key=repr)


def answers(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("kind", ["normal", "clusters", "grid", "large"])
def test_clusters_against_lloyd(spark, monkeypatch, kind):
    rng = np.random.default_rng(2)
    n, dim = 700, 64
    x = rng.normal(size=(n, dim))
    if kind == "clusters":
        x = rng.normal(size=(9, dim))[rng.integers(0, 9, n)] * 5 + 0.05 * x
    if kind == "grid":  # ties everywhere
        x = rng.integers(0, 2, (n, dim)) * (rng.random((n, dim)) < 0.05)
    if kind == "large":
        x = x * 20_000
    monkeypatch.setattr(balltree, "TREE", 150)
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert answers(balltree.op13(df)) == lloyd(rows, 16, 3, dim)


def test_whole_balls_are_not_looked_at():
    rng = np.random.default_rng(3)
    at = rng.integers(-2000, 2000, (8, 64))
    x = at[rng.integers(0, 8, 4000)] + rng.integers(-5, 6, (4000, 64))
    tree = balltree.Tree.build(list(range(4000)), x)
    count, total = np.zeros(8, np.int64), np.zeros((8, 64), np.int64)
    assert tree.totals(at, count, total) < 400
    own = balltree.squared(x, at).argmin(1)
    assert count.tolist() == np.bincount(own, minlength=8).tolist()
    assert (total == np.stack([x[own == j].sum(0) for j in range(8)])).all()
    assert (tree.sum[0] == x.sum(0)).all() and sorted(tree.ids) == list(range(4000))


def test_vectors_that_cluster_and_those_that_do_not(spark):
    v = [float(i) for i in range(64)]
    bad = [None, [], v[:63], [*v, 1.0], [None, *v[1:]], [float("nan"), *v[1:]], [float("inf"), *v[1:]]]
    rows = [(1, v), (1, v), (None, [0.5] * 64), (2, [-x for x in v]), *[(10 + i, b) for i, b in enumerate(bad)]]
    df = spark.createDataFrame([(i, b, "x", 3) for i, b in rows], "vec_id long, embedding array<float>, cluster string, distance int")
    assert answers(balltree.op13(df)) == lloyd(rows, 16, 3, 64)
    assert len(answers(balltree.op13(df))) == 4
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert balltree.op13(empty).count() == 0 and balltree.op13(df.where("vec_id >= 10")).count() == 0
    with pytest.raises(Exception, match="beyond"):
        balltree.op13(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")).count()


def test_empty_centroids_stay(spark):
    rows = [(i, [1.0] * 64) for i in range(30)] + [(99, [2.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = answers(balltree.op13(df))
    assert got == lloyd(rows, 16, 3, 64) and len({r[1] for r in got}) <= 2
