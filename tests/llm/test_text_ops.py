"""Language id, quality, BPE, token counts, transport streams: edge cases and independent results."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import bpe, langid_crf, mpegts, quality_cnn, tokencount

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n", "a", "ééé", "12 34 !!", "word " * 30_000, "x" * 200_000, "日本語 テキスト", "a\u0000b", "the same", "the same"]


def docs(spark, texts=ODD, extra=None):
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, *([rows[-1]] if rows else []), (None, "no id", "en", "s", 1)], SCHEMA)
    for name in extra or []:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("mine"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- language id


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    e, start, trans = rng.random((7, 3)) + 0.1, rng.random(3) + 0.1, rng.random((3, 3)) + 0.1
    first = np.array([1, 0, 0, 0, 1, 0, 0], bool)
    want, total = np.zeros((7, 3)), 0.0
    for path in itertools.product(range(3), repeat=7):
        w = 1.0
        for t, y in enumerate(path):
            w *= e[t, y] * (start[y] if first[t] else trans[path[t - 1], y])
            want[t, y] += 0
        total += w
        for t, y in enumerate(path):
            want[t, y] += w
    for steps in (1, 2, 3, 5, 16):
        assert np.allclose(langid_crf.marginals(e, first, start, trans, steps), want / total)


def test_language_of_held_out_documents(spark, sf):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid_crf.op1(d).collect()}
    truth = {r.doc_id: r.lang for r in d.collect()}
    assert got.keys() == truth.keys()
    held = [i for i, r in got.items() if r.held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert len(held) > 100 and sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.98


def test_code_switched_spans(spark):
    en, fr = "the and of with from this that are " * 12, "le des une pour dans avec être qui " * 12
    m = langid_crf.train([en, en, fr, fr], ["en", "en", "fr", "fr"])
    d = docs(spark, [en + fr])
    r = langid_crf.identified(d.where("doc_id = 0"), m, with_spans=True).first()
    assert r.n_switches == 1 and [s.lang for s in r.spans] == ["en", "fr"] and sum(s.n_words for s in r.spans) == r.n_words


def test_language_edge_cases(spark):
    rows = langid_crf.op1(docs(spark)).collect()
    assert len(rows) == len(ODD) + 2
    by = {r.doc_id: r for r in rows}
    for i, t in enumerate(ODD):
        letters = bool(t and any(c.isalpha() for c in t))
        assert (by[i].lang_pred != "und") == letters and 0 <= by[i].score <= 1
    assert by[11].score == by[12].score
    assert langid_crf.op1(empty(spark)).count() == 0
    same = langid_crf.identified(docs(spark, extra=["score", "lang_pred"]), None, keep=("doc_id", "score", "source")).collect()
    assert {r.lang_pred for r in same} == {"und"} and {r.score for r in same} == {0.0}


# ---- quality


def test_chunks_cover_every_byte():
    for sizes in ([0], [1, 0, 255, 256, 257], [10_000, 3], [224 * 5 + 256]):
        off = np.cumsum([0, *sizes])
        start, size, doc = quality_cnn.chunks(off)
        seen = np.zeros(off[-1], int)
        for s, n, _ in zip(start, size, doc):
            seen[s : s + n] += 1
        assert (seen >= 1).all() and sorted(set(doc)) == list(range(len(sizes)))


def naive_scores(m, texts):
    """The network, one window and one filter at a time."""
    out = []
    for t in texts:
        total = weight = 0.0
        start = 0
        while True:
            part = t[start : start + quality_cnn.CHUNK]
            padded = part.ljust(quality_cnn.CHUNK, b"\0")
            best = [-1e9] * quality_cnn.FILTERS
            for at in range(0, quality_cnn.CHUNK - quality_cnn.WIDTH + 1, quality_cnn.STRIDE):
                if at < max(1, len(part)):
                    x = np.concatenate([m["emb"][b] for b in padded[at : at + quality_cnn.WIDTH]]).astype(float)
                    best = [max(b, float(x @ m["conv"][:, f])) for f, b in enumerate(best)]
            f = np.array([max(0.0, b + float(m["bias"][i])) for i, b in enumerate(best)] + [len(part) / quality_cnn.CHUNK])
            z = float(np.tanh(f @ m["w1"] + m["b1"]) @ m["w2"] + m["b2"][0])
            total, weight = total + z * max(1, len(part)), weight + max(1, len(part))
            if start + quality_cnn.CHUNK >= len(t):
                break
            start += quality_cnn.STEP
        out.append(1 / (1 + np.exp(-total / weight)))
    return out


def small_model():
    texts = [b"good words here " * 20, b"junk!! 11 22 33 " * 15, "été 日本".encode() * 30, b""]
    return quality_cnn.train(texts, np.array([1.0, 0, 1, 0])), texts


def test_scores_against_a_naive_network():
    m, texts = small_model()
    texts += [b"a", bytes(range(256)) * 2, b"x" * 700]
    got = quality_cnn.score(m, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert np.allclose(got, naive_scores(m, texts), atol=1e-4)


def test_gradients_against_differences():
    m, texts = small_model()
    m = {k: v.astype(np.float64) for k, v in m.items()}
    data, off, y = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), np.array([0.0, 1, 1, 0])
    start, size, own = quality_cnn.chunks(off)
    x = quality_cnn.matrix(data, start, size)
    g = quality_cnn.gradients(m, x, size, own, y)

    def loss():
        p = quality_cnn.score(m, data, off)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    rng = np.random.default_rng(1)
    for k, v in m.items():
        flat = v.reshape(-1)
        far = np.argsort(-np.abs(g[k].reshape(-1)))[:20]
        for i in rng.choice(far, min(3, len(far)), replace=False):
            was, step = flat[i], 1e-2
            flat[i] = was + step
            up = loss()
            flat[i] = was - step
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * step) - g[k].reshape(-1)[i]) < 0.1 * abs(g[k].reshape(-1)[i]) + 2e-3, k


def test_samples_are_bounded_and_whole(spark):
    rows = [(i, f"text {i} " * (1 + i % 40), "en" if i % 3 else "fr", "s", 0) for i in range(400)] + [(1000, "long " * 5000, "en", "s", 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    lab = d.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    whole = {r[0]: r[1] for r in rows}
    got = quality_cnn.sample(d, lab, rows=300, chars=20_000).collect()
    assert 50 < len(got) <= 300 and sum(len(r.text) for r in got) <= 20_000 and all(r.text == whole[r.doc_id] for r in got)
    got = langid_crf.sample(d, rows=50, letters=10_000).collect()
    assert {r.lang for r in got} == {"en", "fr"} and sum(len(r.text) for r in got) <= 10_000 and all(r.text == whole[int(r.doc_id)] for r in got)
    assert {r.lang for r in langid_crf.sample(d, languages=1).collect()} == {"en"}


def test_quality_learns_and_scores_whole_texts(spark):
    base = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = {r.doc_id: r for r in quality_cnn.op10(d, lab).collect()}
    held = [(got[r.doc_id].predicted, r.quality) for r in lab.collect() if got[r.doc_id].held_out]
    assert len(got) == 1000 and len(held) > 50
    assert sum(p == y for p, y in held) / len(held) > 0.9
    kept = quality_cnn.kept(d, quality_cnn.fit(d, lab))
    assert kept.columns == d.columns and kept.count() == sum(r.predicted for r in got.values())


def test_quality_edge_cases(spark):
    lab = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, None, 0), (4, 1, 0), (4, 1, 0), (5, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality_cnn.op10(docs(spark), lab).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    none = quality_cnn.op10(docs(spark), lab.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_cnn.op10(empty(spark), lab).count() == 0
    assert quality_cnn.kept(docs(spark, extra=["predicted"]), None).columns[-1] == "predicted"


# ---- BPE


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.public_path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def hostile(n=400):
    rng = random.Random(6)
    alpha = "ab c\n'sé́ΣİI<|endoftext|> \t\x1c .,9!?日本\U0001f600"
    out = ["".join(rng.choice(alpha) for _ in range(rng.choice([5, 50, 900]))) for _ in range(n)]
    return [*out, "a<|endoftext|>b <|STARTOFTEXT|> <|startof", "don't we'LL x.'s", "ÀÉ.ß, ª.", "ẛ̣"]


@pytest.mark.parametrize("mean", [8, 64, 512])
def test_bpe_agrees_with_the_library(lib, mean):
    texts = [t or "" for t in ODD if not t or len(t) < 100_000] + hostile()
    raw = [t.encode() for t in texts]
    enc = bpe.Encoder(bpe.public_path("word_bpe_49k.json"), mean)
    ids = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, i, s in zip(texts, ids, enc.decode(bpe.listed(ids)).to_pylist(), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(i, np.int32).tolist() == want
        assert s == lib.decode(want, skip_special_tokens=False)


def test_bpe_other_files_go_through_the_library(lib):
    from tokenizers import Tokenizer

    path = bpe.public_path("byte_bpe_50k.json")
    enc, own = bpe.Encoder(path), Tokenizer.from_file(path)
    raw = [t.encode() for t in ("Hello  there", "", "é\n\n x")]
    ids = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, i, s in zip(raw, ids, enc.decode(bpe.listed(ids)).to_pylist(), strict=True):
        assert np.frombuffer(i, np.int32).tolist() == own.encode(t.decode(), add_special_tokens=False).ids and s == own.decode(np.frombuffer(i, np.int32).tolist(), skip_special_tokens=False)


def test_shared_passages_are_cut_alike():
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(4000)).encode()
    cut = []
    for head in (b"", b"some other words "):
        data = np.frombuffer(head + passage, np.uint8)
        ends, _ = bpe.cuts(data, np.array([0, len(data)]), 64)
        cut.append({int(e) - len(head) for e in ends if e - len(head) > 16})
    assert cut[0] == cut[1] and len(cut[0]) > 20


def test_repeated_chunks_are_encoded_once_over_batches():
    """Passages that come again many batches later are taken from the cache; ids are those of a fresh encoder."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(900)) for _ in range(20)]
    enc = bpe.Encoder(bpe.public_path("word_bpe_49k.json"))
    for batch in range(6):
        texts = [f"{batch} {' '.join(word() for _ in range(200))} {p} {batch}" for p in passages]
        raw = [t.encode() for t in texts]
        before = enc.encoded, enc.seen
        got = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        if batch:
            assert (enc.encoded - before[0]) / (enc.seen - before[1]) < 0.5
    fresh = bpe.Encoder(bpe.public_path("word_bpe_49k.json"))
    assert got == fresh.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def test_bpe_query_and_decoding(spark, lib):
    d = docs(spark, extra=["ids", "decoded"])
    rows = bpe.digests(bpe.encoded(d)).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        t = "no id" if r.doc_id is None else ODD[r.doc_id] or ""
        ids = lib.encode(t, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    again = {r.doc_id: r for r in bpe.decoded(bpe.encoded(d)).collect()}
    assert again[4].decoded == "a</w>"
    assert bpe.op4(empty(spark)).count() == 0


def test_cache_is_bounded():
    c = bpe.Cache(3)
    for i in range(100):
        c.put(i, (i,))
    assert len(c.young) + len(c.old) <= 6 and c.get(99) == (99,) and c.get(0) is None


# ---- token counts


@pytest.mark.parametrize("fallback", [True, False])
def test_counts_agree_with_the_library(fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    v = tokencount.vocabulary(bpe.public_path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram(v, 0, fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    texts = [x or "" for x in ODD if not x or len(x) < 100_000] + hostile()
    c = tokencount.Counter(v, 0, fallback)
    vocab, ids, off = tokencount.words(pa.array(texts))
    per = c.count(vocab)[ids]
    got = np.diff(np.r_[0, np.cumsum(per)][off])
    assert got.tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_counts_with_ties():
    from tokenizers import Tokenizer, models

    v = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("bab", -3.0)]
    t = Tokenizer(models.Unigram(v, 0, False))
    c = tokencount.Counter(v, 0, False)
    for n in range(1, 9):
        for w in itertools.product("abx", repeat=n):
            text = "".join(w)
            assert c.word(text) == len(t.encode(text).ids), text


def test_a_long_word_takes_bounded_memory():
    import tracemalloc

    v = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -1.5)]
    c = tokencount.Counter(v, 0, False)
    tracemalloc.start()
    assert c.word("ab" * 100_000) == 100_000
    assert tracemalloc.get_traced_memory()[1] < 3_000_000
    tracemalloc.stop()


def test_counts_query(spark):
    rows = {r.doc_id: r for r in tokencount.op8(docs(spark, extra=["n_tokens"])).collect()}
    assert rows[0].n_tokens == rows[1].n_tokens == 0 and rows[11].n_tokens == rows[12].n_tokens > 0
    assert rows[7].n_words == 30_001  # the last blank begins a word too
    assert tokencount.op8(empty(spark)).count() == 0


# ---- transport streams


@pytest.mark.parametrize("n", [64, 128, 192, 4096, 4160, 8192, 65_536, 100_032])
def test_streams_round_trip(n):
    body = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8)
    ts = mpegts.mux(body)
    got = mpegts.demux(ts)
    es = got.streams[0]
    assert len(ts) % 188 == 0 and es.payload == body.tobytes() and got.programs == {1: mpegts.PMT_PID}
    assert (got.discontinuities, got.bad_sync, got.bad_sections, es.bad_units) == (0, 0, 0, 0)
    assert es.pts == [k * 4096 * 90_000 // 8000 for k in range(es.units)] and es.random_access == [k % 8 == 0 for k in range(es.units)]


def literal_crc(data):
    c = 0xFFFFFFFF
    for byte in data:
        for k in range(7, -1, -1):
            top = (c >> 31) ^ (byte >> k & 1)
            c = (c << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if top else 0)
    return c


def literal_stream(data):
    """A reader by the standard's tables, packet by packet: elementary bytes, timestamps, and places of random-access points."""
    assert len(data) % 188 == 0
    counters, sections, pes, stamps, points, programs, es = {}, {}, [], [], [], {}, None
    for at in range(0, len(data), 188):
        p = data[at : at + 188]
        assert p[0] == 0x47 and not p[1] & 0x80
        pid, begins, has, counter = (p[1] & 0x1F) << 8 | p[2], p[1] & 0x40, p[3] >> 4 & 3, p[3] & 15
        if pid == 0x1FFF:
            continue
        body, access = p[4:], False
        if has & 2:
            access = body[0] > 0 and bool(body[1] & 0x40)
            body = body[1 + body[0] :]
        if not has & 1:
            continue
        assert counters.get(pid, (counter - 1) % 16) == (counter - 1) % 16
        counters[pid] = counter
        if pid == 0 or pid in programs.values():
            assert begins
            section = body[1 + body[0] :]
            section = section[: 3 + ((section[1] & 15) << 8 | section[2])]
            assert literal_crc(section) == 0
            sections[pid] = section
            if pid == 0:
                programs = {section[i] << 8 | section[i + 1]: (section[i + 2] & 0x1F) << 8 | section[i + 3] for i in range(8, len(section) - 4, 4)}
            else:
                i = 12 + ((section[10] & 15) << 8 | section[11])
                es = (section[i + 1] & 0x1F) << 8 | section[i + 2]
        elif pid == es:
            if begins:
                assert body[:3] == b"\x00\x00\x01"
                pes.append(b"")
                if access:
                    points.append(len(pes) - 1)
            pes[-1] += body
    out = b""
    for unit in pes:
        length = unit[4] << 8 | unit[5]
        assert not length or length == len(unit) - 6
        if unit[7] & 0x80:
            s = unit[9:14]
            stamps.append((s[0] >> 1 & 7) << 30 | s[1] << 22 | (s[2] >> 1) << 15 | s[3] << 7 | s[4] >> 1)
        out += unit[9 + unit[8] :]
    return out, stamps, points


@pytest.mark.parametrize("n", [64, 128, 4096, 4160, 40_000, 200_000])
def test_streams_against_a_literal_reader(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)
    out, stamps, points = literal_stream(bytes(mpegts.mux(payload)))
    assert out == payload.tobytes()
    assert len(stamps) == -(-n // mpegts.UNIT) and all(b - a == mpegts.UNIT * mpegts.CLOCK // mpegts.RATE for a, b in zip(stamps, stamps[1:], strict=False))
    assert points == list(range(0, len(stamps), mpegts.RAP_EVERY))


def test_damaged_streams_are_noticed():
    body = np.arange(20_000, dtype=np.uint32).astype(np.uint8)
    ts = bytearray(mpegts.mux(body))
    lost = bytes(ts[: 188 * 10] + ts[188 * 11 :])
    assert mpegts.demux(lost).discontinuities == 1 and mpegts.demux(lost).streams[0].payload != body.tobytes()
    twice = bytes(ts[: 188 * 11] + ts[188 * 10 :])
    assert mpegts.demux(twice).discontinuities == 0 and mpegts.demux(twice).streams[0].payload == body.tobytes()
    unsynced = ts.copy()
    unsynced[188 * 5] = 0
    assert mpegts.demux(bytes(unsynced)).bad_sync == 1
    pat = ts.copy()
    pat[8] ^= 1
    assert mpegts.demux(bytes(pat)).bad_sections == 1 and not mpegts.demux(bytes(pat)).streams
    assert mpegts.demux(b"").packets == 0


def test_streams_query(spark):
    rows = {r.doc_id: r for r in mpegts.stored_texts(docs(spark, extra=["feature"]), with_media=True, with_points=True).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert r.points[0].random_access and mpegts.demux(bytes(r.media)).streams[0].payload == padded
    assert rows[11].feature == rows[12].feature
    assert mpegts.stored_texts(empty(spark)).count() == 0
