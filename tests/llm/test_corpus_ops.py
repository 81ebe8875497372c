"""Secrets, near duplicates, mixing, nearest neighbours, licenses, the pipeline: against brute force and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import components, jaccard, licenses, mixing, queries, secrets, vptree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, *extra):
    df = spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], SCHEMA)
    for name in extra:
        df = df.withColumn(name, F.lit("mine"))
    return df


def duck(sf, sql):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.execute(sql)
    cols = [d[0] for d in got.description]
    return cols, got.fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, sf, name):
    cols, want = duck(sf, queries.ORACLES[name])
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(cols)
    have = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    norm = lambda rows: sorted((tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=repr)
    assert norm(have) == norm(want)


# ---- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base_spans(text):
    out = []
    for m in ASSIGN.finditer(text):
        if len(m.group(2)) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_secrets_against_regular_expressions(spark):
    rng = random.Random(1)
    bits = ["password", "Secret", "token", "api_key", "APIKEY", "'", '"', " ", ":", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "xYz09", "é", "\U0001f600", "\n", ".", "-", "secret: token: aaaaaaaaaaaa"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([3, 12, 60]))) for _ in range(300)]
    texts += [None, "", "secret: token: abcdefghijklmnop", "AKIA" * 10, "f" * 100_000, ("token = abcdefghijkl " * 2000)]
    rows = [(i, t, "en", f"s{i % 7}") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s0"), (None, "token=abcdefghijklm", None, None)]
    got = secrets.op2(frame(spark, rows, "spans", "digest", "salt")).collect()
    assert len(got) == len(rows)
    for r in got:
        t = "token=abcdefghijklm" if r.doc_id is None else texts[r.doc_id] or ""
        want = base_spans(t)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(len(re.findall(rf"\b{k}:", want)) for k in ("assign", "access", "hex"))
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert sum(r.n_assign for r in got) > 50
    assert secrets.op2(frame(spark, [])).count() == 0


def test_ownership_parts_examples_from_credentials(spark):
    wide, own, token = "token = abcdefabcdefabcdef", "token = fedcbafedcbafedcba99", "key Zz9_qwrtqwrtqwrtqwrtqwrtqwrt end"
    rows = [(i, f"copied {wide}", "en", f"s{i}") for i in range(5)] + [(10, f"mine {own}", "en", "s1"), (11, f"mine {own}", "en", "s1"), (12, token, "en", "s2")]
    rows += [(20 + i, "Ww8_mnopmnopmnopmnopmnopmnop", "en", f"s{i}") for i in range(4)]
    got = {r.doc_id: r for r in secrets.op2(frame(spark, rows)).collect()}
    assert got[0].n_live == 0 and got[0].n_example == 2  # assignment and the hex in it
    assert got[10].n_live == 2 and got[12].n_token == 1 and got[12].spans == "token:4:32"
    assert got[20].n_token == 0 and got[20].spans == ""
    red = {r.doc_id: r for r in secrets.redacted(frame(spark, rows)).collect()}
    assert len(red) == len(rows) and red[0].text == f"copied {wide}"
    assert "fedcba" not in red[10].text and red[10].n_chars == len(red[10].text) and red[12].text == "key [secret] end"


def test_redaction_cuts_spans_and_leaves_the_rest(spark):
    word, key = "informationsystem", "zx81" * 5
    texts = [f"password: {word} and {word}s are fine", f"token = {key} or secret={key}.{key}", None, "", "clean", f"é\U0001f600 secret: {key} end " + "pad " * 40_000]
    odd = ["digest", "salt", "__values", "key", "parts", "new", "row", "hash"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s")]
    df = frame(spark, rows, *odd)
    red = secrets.redacted(df)
    assert red.columns == df.columns
    got = {r.doc_id: r for r in red.collect()}
    assert red.count() == len(rows) and all(r[c] == "mine" for r in got.values() for c in odd)
    assert got[0].text == f"password: [secret] and {word}s are fine" and got[1].text == "token = [secret] or secret=[secret]"
    assert (got[2].text, got[3].text, got[4].text) == (None, "", "clean") and got[5].text == "é\U0001f600 secret: [secret] end " + "pad " * 40_000
    assert got[0].n_chars == len(got[0].text) and secrets.redacted(frame(spark, [])).count() == 0


def test_many_repositories_make_an_example(spark):
    value = "token = " + "abc9" * 5
    rows = [(i, value, "en", "s0") for i in range(secrets.REPOS)] + [(100 + i, value.replace("9", "8"), "en", "s0") for i in range(secrets.REPOS - 1)]
    got = {r.doc_id: r for r in secrets.op2(frame(spark, rows + rows[:3])).collect()}
    assert (got[0].n_live, got[0].most_owners, got[0].most_repos) == (0, 1, secrets.REPOS) and got[100].n_live > 0 and got[100].most_repos == secrets.REPOS - 1


# ---- near duplicates


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent, links = list(range(len(sets))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(i)
    low = {i: min((sets[k][0] for k in g if sets[k][0] is not None), default=None) for g in groups.values() for i in g}
    return Counter((sets[i][0], low[i], links[i]) for i in range(len(sets)))


def near_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    chain = [word() for _ in range(60)]
    for _ in range(40):  # a large group whose ends are not alike
        chain = [*chain[1:], word()]
        rows.append((n, " ".join(chain)))
        n += 1
    passage = " ".join(word() for _ in range(40))
    for _ in range(30):  # a passage that unlike texts share
        rows.append((n, " ".join(word() for _ in range(80)) + " " + passage))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "One, TWO!"), (n + 4, "..."), (n + 5, "... "), (n + 6, "w " * 50_000), (n + 6, "w " * 50_000), (None, rows[0][1]), (None, "alone without an id at all here")]
    return rows


@pytest.mark.parametrize(("small", "block"), [(1024, 1024), (4, 1024), (4, 5), (1024, 2)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_rows()
    df = frame(spark, [(d, t, "en", "s") for d, t in rows], "key", "sig", "id", "class_id")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.linked(df).collect())
    assert got == brute(rows)


def test_places_in_buckets_are_bounded(spark):
    """A large group of near copies has the paths of three levels each, and no more."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(80)]
    texts = []
    for _ in range(10_000):
        w = list(base)
        w[rng.randrange(80)] = word()
        texts.append(" ".join(w))
    sets = jaccard.sketched(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), "text", ["doc_id"]).dropDuplicates(["key"])
    small, edges = jaccard.buckets(sets)
    assert small.count() + edges.count() <= sum(map(jaccard.runs_of, range(1, jaccard.LEVELS + 1))) * 10_000
    found = small.groupBy("path").count()
    assert found.where(found["count"] > jaccard.SMALL).isEmpty() and edges.count() > 10_000


def test_one_of_each_class(spark):
    rows = near_rows()
    df = frame(spark, [(d, t, "en", "s") for d, t in rows], "key")
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    ids = Counter(r.doc_id for r in kept.collect())
    want = {low if d is not None else None for d, low, _ in brute(rows)}
    assert set(ids) - {None} == want - {None} and all(n == 1 for d, n in ids.items() if d is not None)
    assert jaccard.linked(frame(spark, [])).count() == 0 and jaccard.one_of_each(frame(spark, [])).count() == 0


def test_one_of_each_decides_by_row(spark):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60))
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [
        (1, a), (5, near(a)), (5, b),  # b shares its id with a copy of a
        (6, c), (6, d),  # clean texts under one id
        (None, near(c)),  # a copy of a text with an id
        (None, e), (None, near(e)), (None, near(e)),  # copies without ids
        (None, None), (None, None), (None, ""), (None, "..."), (7, ""), (7, ""),  # without links
        (8, f), (8, f), (9, f), (8, near(f)),
    ]
    got = Counter((r.doc_id, r.text) for r in jaccard.one_of_each(frame(spark, [(i, t, "en", "s") for i, t in rows])).collect())
    either = [x for x in ((None, e), (None, near(e))) if x in got]
    last = [x for x in ((8, f), (8, near(f))) if x in got]
    assert len(either) == len(last) == 1
    assert got == Counter([(1, a), (5, b), (6, c), (6, d), (None, None), (None, None), (None, ""), (None, "..."), (7, ""), (7, ""), *either, *last])


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 420)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


# ---- mixing


def test_raking_meets_the_targets():
    rng = np.random.default_rng(5)
    keys = [(f"s{a}", f"l{b}") for a in range(4) for b in range(3)]
    t = rng.integers(10, 1000, len(keys)).astype(float)
    shares = [{"s0": 0.1, "s1": 0.2, "s2": 0.3, "s3": 0.4}, {"l0": 0.5, "l1": 0.25, "l2": 0.25}]
    w = mixing.rake_small(keys, t, shares, 60)
    for i, share in enumerate(shares):
        for v, x in share.items():
            assert math.isclose(sum(w[k] * t[k] for k, key in enumerate(keys) if key[i] == v) / t.sum(), x, rel_tol=1e-6)
    assert mixing.residual(keys, t, w, shares) < 1e-6 < mixing.residual(keys, t, np.ones(len(t)), shares)
    for budget in (0.05, 0.6, 1.0):
        p = np.minimum(1, mixing.scale(w, t, budget) * w)
        assert math.isclose((p * t).sum(), budget * t.sum(), rel_tol=1e-9)


def test_mixing_large_and_small_ways_agree(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    small = {r.doc_id: r for r in mixing.mixed(d).collect()}
    large = {r.doc_id: r for r in mixing.mixed(d, most=0, rounds=3).collect()}
    few = {r.doc_id: r for r in mixing.mixed(d, rounds=3).collect()}
    assert all(math.isclose(large[i].weight, few[i].weight, rel_tol=1e-6, abs_tol=1e-8) and math.isclose(large[i].p, few[i].p, rel_tol=1e-5, abs_tol=1e-8) for i in few)
    drawn = sum(r.n_tokens for r in small.values() if r.kept) / sum(r.n_tokens for r in small.values())
    assert 0.35 < drawn < 0.85


def test_mixing_edge_cases(spark):
    rows = [(0, None, None, None), (1, "", "en", "a"), (2, "x y z", "en", "a"), (2, "x y z", "en", "a"), (None, "w w", "fr", None), (3, "q " * 5000, "fr", "b")]
    df = frame(spark, rows, "p", "weight", "topic", "row")
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows) and all(0 <= r.p <= 1 for r in got) and len({r.kept for r in got if r.doc_id == 2}) == 1
    assert mixing.sampled(df).columns == df.columns
    assert mixing.mixed(frame(spark, [])).count() == 0
    assert {r.weight for r in mixing.mixed(frame(spark, rows[:2])).collect()} == {1.0}
    a, b = ({(r.doc_id, r.weight) for r in mixing.mixed(df, {"lang": x}).collect()} for x in ({"fr": 1.0, "en": 1.0}, {"fr": 1.0, "en": 1.0, "none": 5.0}))
    assert a == b  # a target that no document has is spread over the others
    only = mixing.mixed(df, {"lang": {"fr": 1.0}}).collect()
    assert all(r.p == 0 for r in only if r.doc_id in (1, 2)) and any(r.p > 0 for r in only if r.doc_id == 3)


# ---- nearest neighbours


def exact(x, ids, k):
    s = x @ x.T
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        order = [j for j in np.lexsort((ids, -s[i])) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), s[i, j]) for j in order]
    return out


def vectors(n, dim=16, clusters=0, seed=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if clusters:
        x = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] * 3 + 0.4 * x
    return x.astype(np.float32).astype(float), np.arange(n)


@pytest.mark.parametrize("clusters", [0, 10])
def test_factor_one_is_exact(spark, monkeypatch, clusters):
    monkeypatch.setattr(vptree, "SHARD", 300)
    monkeypatch.setattr(vptree, "BLOCK", 20)
    monkeypatch.setattr(vptree, "LEAF", 16)
    x, ids = vectors(900, clusters=clusters)
    df = spark.createDataFrame([(int(i), [float(v) for v in x[i]]) for i in ids], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, factor=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = exact(x, ids, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]])


def test_default_factor_has_the_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    want = exact(x, ids, 20)
    got = defaultdict(set)
    for r in vptree.op6(e).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & {v for v, _ in w}) for q, w in want.items()) / sum(map(len, want.values())) > 0.95


@pytest.mark.parametrize("norms", ["gaussian", "equal", "outlier", "spread", "clusters"])
def test_default_factor_with_unequal_norms(norms):
    """Several shards, each searched by itself, as the query does."""
    rng = np.random.default_rng(11)
    n, k, shards = 6000, 20, 3
    x = rng.normal(size=(n, 64))
    if norms == "clusters":
        x = rng.normal(size=(30, 64))[rng.integers(0, 30, n)] * np.exp(0.6 * rng.normal(size=n))[:, None] + 0.3 * x
    elif norms != "gaussian":
        x /= np.linalg.norm(x, axis=1)[:, None]
        x *= {"equal": np.ones(n), "outlier": np.r_[50, np.ones(n - 1)], "spread": np.exp(0.6 * rng.normal(size=n))}[norms][:, None]
    ids = np.arange(n)
    part = lambda rows: pa.table({"vec_id": ids[rows], "mark": np.zeros(len(rows), np.int64), "dim": np.full(len(rows), 64), "v": pa.array(list(x[rows]), pa.list_(pa.float64()))})
    near = defaultdict(list)
    for s in range(shards):
        for b in vptree.Shard(part(ids[s::shards])).search(part(ids[::20]), k, vptree.FACTOR):
            for r in b.to_pylist():
                near[r["query_id"]].append((-r["score"], r["vec_id"]))
    want = exact(x, ids, k)
    assert sum(len({v for _, v in sorted(near[q])[:k]} & {v for v, _ in w}) for q, w in want.items()) / (k * len(want)) > 0.95


@pytest.mark.parametrize("kind", ["latent 8", "latent 4, equal norms", "latent 2", "two dimensions", "random walk", "clusters of latent 3"])
def test_recall_with_few_intrinsic_dimensions(kind):
    rng = np.random.default_rng(12)
    n, k, shards = 6000, 20, 3
    latent = lambda d: rng.normal(size=(n, d)) @ rng.normal(size=(d, 64))
    if kind.startswith("latent"):
        x = latent(int(kind.split()[1].strip(",")))
        if "equal" in kind:
            x /= np.linalg.norm(x, axis=1)[:, None]
    elif kind == "two dimensions":
        x = rng.normal(size=(n, 2))
    elif kind == "random walk":
        x = np.cumsum(rng.normal(size=(n, 64)), 0)
    else:
        x = latent(3) + 4 * rng.normal(size=(20, 64))[rng.integers(0, 20, n)]
    ids = np.arange(n)
    size = x.shape[1]
    part = lambda rows: pa.table({"vec_id": ids[rows], "mark": np.zeros(len(rows), np.int64), "dim": np.full(len(rows), size), "v": pa.array(list(x[rows]), pa.list_(pa.float64()))})
    near = defaultdict(list)
    for s in range(shards):
        shard = vptree.Shard(part(ids[s::shards]))
        for b in shard.search(part(ids[::20]), k):
            for r in b.to_pylist():
                near[r["query_id"]].append((-r["score"], r["vec_id"]))
    want = exact(x, ids, k)
    assert sum(len({v for _, v in sorted(near[q])[:k]} & {v for v, _ in w}) for q, w in want.items()) / (k * len(want)) > 0.9


def test_an_id_may_have_several_vectors(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [5.0, 0.0]), (1, [5.0, 0.0]), (20, [3.0, 1.0])], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vptree.op6(df).orderBy("mark", "rank").collect():
        got[r.mark].append((r.query_id, r["rank"], r.vec_id, r.score))
    assert sorted(got.values()) == [[(20, 1, 1, 5.0), (20, 2, 20, 3.0), (20, 3, 1, 0.0)], [(20, 1, 1, 15.0), (20, 2, 20, 3.0), (20, 3, 1, 1.0)]]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (1, [1.0, 0.0]), (40, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("mine"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vptree.op6(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 2.0), (0, 2, 1, 1.0), (0, 3, 20, 1.0), (20, 1, 2, 2.0), (20, 2, 0, 1.0), (20, 3, 1, 1.0)]
    assert vptree.op6(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(400)], "vec_id long, embedding array<double>")
    first = [r.vec_id for r in vptree.op6(same).where("query_id = 0").orderBy("rank").collect()]
    assert first == list(range(1, 21))


# ---- licenses


def test_anchors_and_bounds_are_exact():
    rng = random.Random(8)
    words = licenses.anchors(licenses.TEMPLATES)
    for text in licenses.TEMPLATES.values():
        b = licenses.bigrams(text)
        lo, hi = licenses.bounds(len(b))
        for _ in range(300):
            tokens = re.sub(r"[\W_]+", " ", text.lower()).split()
            for _ in range(rng.randint(0, len(tokens) // 3 + 2)):
                tokens[rng.randrange(len(tokens))] = "zzz"
            a = set(licenses.bigrams(" ".join(tokens)))
            dice = 2 * len(a & set(b)) / (len(a) + len(b)) if a else 0
            if dice >= licenses.LEAST:
                assert lo <= len(a) <= hi and any(w in " ".join(tokens) for w in words)


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit-permission"]
    rows = [(0, None), (1, ""), (2, "word"), (3, "Some text.\nReleased under the MIT License.\nMore."), (4, "RELEASED   under the *MIT* license"), (5, mit), (6, "intro\n\n" + mit + "\n\noutro"), (7, mit.replace("persons", "people")), (8, "the MIT term paper"), (9, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (9, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (10, "x " * 100_000 + "\nLicensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: r for r in licenses.op7(frame(spark, [(i, t, "en", "s") for i, t in rows], "license", "dice")).collect()}
    assert [got[i].license for i in range(11)] == [None, None, None, "mit", "mit", "mit-permission", "mit-permission", "mit-permission", None, "cc-by-nc-4.0", "apache-2.0"]
    assert got[3].dice == 1 and 0.8 <= got[7].dice < 1 and got[9].licenses == "cc-by-nc-4.0,mit"
    assert licenses.op7(frame(spark, [])).count() == 0


def test_embedded_license_statements(spark):
    isc, gpl = licenses.TEMPLATES["isc-permission"], licenses.TEMPLATES["gpl-3.0"]
    wrapped = "Some words go ahead of it. This code is licensed, as we said, Licensed under the\nApache License, Version 2.0. More words\nfollow in the paragraph."
    rows = [
        (0, "This project is released under the MIT License. See LICENSE for details."),
        (1, wrapped),
        (2, "".join(f"int v{i}; " for i in range(40)) + " ".join(isc.split()) + " int main(void) { return a; } int b;"),
        (3, "We say: " + gpl.replace("This work", "This code") + " Read on for many other things that are told here."),
        (4, "The license of the public source, under a general release."),
        (5, "We say: released under the BSD terms, or the MIT term paper, and so on and so on."),
        (6, "A is released under the MIT License and B is licensed under CC BY-SA 4.0 and that is all of it."),
        (7, "Released under the MIT License.\nAgain it is released under the MIT License, as we said."),
    ]
    got = {r.doc_id: r for r in licenses.op7(frame(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    assert [got[i].licenses for i in range(8)] == ["mit", "apache-2.0", "isc-permission", "gpl-3.0", "", "", "cc-by-sa-4.0,mit", "mit"]
    assert got[0].dice == got[1].dice == got[2].dice == 1 and got[3].license == "gpl-3.0" and 0.8 <= got[3].dice < 1
    assert got[6].n_matches == 2 and got[7].n_matches == 1


def plain_words(text):
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def dice_of(a, b):
    """Of sets, 0 without a version number of b's in a, if b has any."""
    v = set(licenses.versions(sorted(b)))
    return 2 * len(a & b) / (len(a) + len(b)) if a and (not v or v & a) else 0


def unit_hits(text, sets):
    lower = (text or "").lower()
    units = {frozenset(licenses.bigrams(u)) for u in {*lower.split("\n"), *re.split("\n[ \t\r]*\n", lower), lower}}
    return [(dice_of(a, b), k) for a in units for k, b in sets.items() if dice_of(a, b) >= licenses.LEAST]


def run_hits(text, sets):
    """The best of all runs of words, of each template."""
    w = plain_words(text or "")
    pairs, out = [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)], {}
    for k, b in sets.items():
        high = licenses.bounds(len(b))[1] + 2
        out[k] = max((dice_of(set(pairs[i:j]), b) for i in range(len(pairs)) for j in range(i + 1, min(len(pairs), i + high) + 1)), default=0)
    return out


def test_licenses_against_all_runs_of_words(spark):
    """Short texts, in which statements are edited, cut, joined and repeated."""
    rng = random.Random(13)
    short = {k: v for k, v in licenses.TEMPLATES.items() if len(plain_words(v)) < 40}
    sets = {k: set(licenses.bigrams(v)) for k, v in short.items()}
    texts = [None, "", "x"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 3)):
            part = plain_words(rng.choice(list(short.values())))
            part = [rng.choice(["the", "other", "license", "2"]) if rng.random() < 0.08 else x for x in part]
            parts += [*("some words here go before".split()[: rng.randint(0, 5)]), *part[rng.randint(0, 2) :], *("and after".split()[: rng.randint(0, 2)])]
        texts.append(" ".join(parts))
    got = {r.doc_id: r for r in licenses.matched(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), short).collect()}
    found = 0
    for i, t in enumerate(texts):
        own = {k for _, k in unit_hits(t, sets)}
        want = {k for k, d in run_hits(t, sets).items() if d >= licenses.LEAST} | own
        have = set(filter(None, got[i].licenses.split(",")))
        assert have == want, t
        found += len(want)
        if want:
            assert len(sets[got[i].license]) == max(len(sets[k]) for k in want)
    assert found > 150


def test_whole_licenses_inside_long_texts(spark, sf):
    rng = random.Random(14)
    junk = lambda n: " ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(n))
    names = ["gpl-2.0-text", "gpl-3.0-text", "lgpl-2.1-text", "apache-2.0-text", "mpl-2.0-text", "bsd-3-clause-text"]
    rows = []
    for name in names:
        t = " ".join(licenses.TEMPLATES[name].split())
        rows += [f"{junk(4000)} {t} {junk(4000)}", f"{junk(50)} {' '.join('other' if rng.random() < 0.03 else w for w in t.split())} {junk(50)}", licenses.TEMPLATES[name], t[: len(t) * 3 // 4]]
    rows += [" ".join([" ".join(licenses.TEMPLATES["apache-2.0-text"].split())] * 20), licenses.TEMPLATES["gpl-3.0-text"][:3000], junk(9000)]
    got = {r.doc_id: r for r in licenses.op7(frame(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])).collect()}
    for i, name in enumerate(names):
        assert [got[4 * i + k].license for k in range(4)] == [name] * 4
        assert not {"gpl-2.0-text": {"gpl-3.0-notice", "gpl-3.0-text"}, "lgpl-2.1-text": {"gpl-3.0-notice", "gpl-2.0-text"}}.get(name, set()) & set(got[4 * i].licenses.split(","))
        assert got[4 * i].dice >= 0.8  # the unit decides where it reaches a template
    assert got[24].license == "apache-2.0-text" and got[24].dice > 0.99
    assert got[26].license is None and got[25].license != "gpl-3.0-text"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {k: set(licenses.bigrams(v)) for k, v in licenses.TEMPLATES.items()}
    have = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in licenses.op7(docs).collect()}
    for r in docs.collect():
        assert {k for _, k in unit_hits(r.text, sets)} <= have[r.doc_id]


def test_long_repetitive_text_against_brute_force(spark):
    text = "Released under the MIT License. " * 200  # one line: longer than the SQL compares
    a, b = set(licenses.bigrams(text)), set(licenses.bigrams(licenses.TEMPLATES["mit"]))
    (got,) = licenses.op7(frame(spark, [(1, text, "en", "s")])).collect()
    assert (got.license, got.dice, got.n_matches) == ("mit", round(2 * len(a & b) / (len(a) + len(b)), 6), 1) and len(text) > 3000
