"""Queries of models that learn: predict then learn, classes, drawn words, classifiers, dictionaries, scorers, token files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chat, classmodel, generation, learners, metrics, relay, sampling, scoring, similarity, vocab
from ..operators.lineage import cut, scratch
from ..sources import readers, records
from ..sources.readers import table
from ..streaming import incremental, learning
from . import sqltext as q
from .catalog import _KEYWORDS, _MEMORY, _QUERY, _classes, _docs, _ids, _parts, _replies, _stored_parts, _stream, _vocab, _words, query

_CASES = f"""{q.TOKENS}, cs AS (SELECT doc_id, (i - 1) // 256 AS chunk, x, y FROM (SELECT doc_id, i, token AS y, lag(token) OVER (PARTITION BY doc_id ORDER BY i) AS x FROM tok) WHERE i >= 1),
g AS (SELECT doc_id, chunk, x, y, count(*) AS n FROM cs GROUP BY ALL),
xy AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id, x, y ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cxy FROM g),
gx AS (SELECT doc_id, chunk, x, coalesce(sum(n) OVER (PARTITION BY doc_id, x ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cx FROM (SELECT doc_id, chunk, x, sum(n) AS n FROM g GROUP BY 1, 2, 3)),
gy AS (SELECT doc_id, chunk, y, coalesce(sum(n) OVER (PARTITION BY doc_id, y ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cy FROM (SELECT doc_id, chunk, y, sum(n) AS n FROM g GROUP BY 1, 2, 3)),
p AS (SELECT doc_id, chunk, n, (cy + 0.1) / (chunk * 256 + 0.1 * 4096) AS a, (cxy + 0.1) / (cx + 0.1 * 4096) AS b FROM xy JOIN gx USING (doc_id, chunk, x) JOIN gy USING (doc_id, chunk, y))"""


@query(f"WITH {_CASES} SELECT doc_id, chunk, CAST(sum(n) AS BIGINT) AS n, round(sum(-ln(b) * n), 4) AS nll FROM p GROUP BY 1, 2")
def adaptive_bigram(spark, sf):
    return learning.causal_bigram(_docs(spark, sf).select("doc_id", X.words(F.col("text")).alias("tokens")))


_SHARE = lambda k, p: f"m{k} + 0.05 * (list_sum(list_transform(c, lambda s: s.n * w{k} * {p} / (w0 / 4096 + w1 * s.a + w2 * s.b))) / 256 - w{k})"


@query(f"""WITH RECURSIVE {_CASES.replace("tok AS MATERIALIZED", "tok AS")},
ch AS (SELECT doc_id, chunk, sum(n) AS n, list({{'n': n, 'a': CAST(a AS DOUBLE), 'b': CAST(b AS DOUBLE)}}) AS c FROM p GROUP BY 1, 2),
rec(doc_id, chunk, m0, m1, m2) AS (SELECT doc_id, chunk, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM ch WHERE chunk = 0 UNION ALL
  SELECT doc_id, chunk + 1, {_SHARE(0, "(1.0 / 4096)")}, {_SHARE(1, "s.a")}, {_SHARE(2, "s.b")}
  FROM (SELECT *, exp(m0) / (exp(m0) + exp(m1) + exp(m2)) AS w0, exp(m1) / (exp(m0) + exp(m1) + exp(m2)) AS w1, exp(m2) / (exp(m0) + exp(m1) + exp(m2)) AS w2 FROM rec) JOIN ch USING (doc_id, chunk) WHERE ch.n = 256),
u AS (SELECT *, exp(m0) / (exp(m0) + exp(m1) + exp(m2)) AS w0, exp(m1) / (exp(m0) + exp(m1) + exp(m2)) AS w1, exp(m2) / (exp(m0) + exp(m1) + exp(m2)) AS w2 FROM rec)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, round(sum(list_sum(list_transform(c, lambda s: -s.n * ln(w0 / 4096 + w1 * s.a + w2 * s.b)))), 4) AS nll, round(sum(list_sum(list_transform(c, lambda s: -s.n * ln(s.a)))), 4) AS nll_unigram,
round(sum(list_sum(list_transform(c, lambda s: -s.n * ln(s.b)))), 4) AS nll_bigram, round(arg_max(w2, chunk), 9) AS w_bigram FROM u JOIN ch USING (doc_id, chunk) GROUP BY 1""")
def predict_then_learn(spark, sf):
    """The documents as a stream of parts of 1000 words; the state goes from part to part."""
    docs = incremental.documents(spark, f"{sf}/documents*.parquet")
    words = docs.select("doc_id", X.words(F.col("text")).alias("t")).where(F.size("t") > 0)
    at = F.explode(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / 1000).cast("int")))
    parts = words.withColumn("k", at).select("doc_id", F.col("k").cast("long").alias("part"), F.slice("t", F.col("k") * 1000 + 1, F.lit(1000)).alias("tokens"))
    out = scratch(spark, "learnt")
    incremental.run_to_end(learning.learnt(parts), incremental.replace_round(out), scratch(spark, "learning"), mode="append")
    return learning.by_document(spark.read.schema(learning.RESULT).parquet(out))


@query(f"WITH {q.TOKENS}, {q.FREQ}, {q.VOCAB}, {q.IDS} SELECT pos, token AS id FROM ids")
def token_bins(spark, sf):
    """The stream's ids written as headerless files and read back in ranges of 64 KB."""
    out = scratch(spark, "bins")
    records.write_tokens(vocab.mapped_stream(_stream(spark, sf), _vocab(_words(spark, sf))), out, "uint16")
    return readers.token_files(spark, f"{out}/*.bin", "uint16", range_bytes=1 << 16).select(F.col("id").alias("pos"), F.col("token").cast("int").alias("id"))


_IDS = f"{q.TOKENS}, {q.FREQ}, {q.VOCAB}, {q.IDS}, {q.parts('ids')}"


def _id_parts(spark, sf):
    v, s = _ids(spark, sf)
    return v, *_parts(s)


@query(f"""WITH {_IDS}, nv AS (SELECT count(*) AS v FROM vocab), cl AS (SELECT id, CAST(floor((id - 1) / ceil(v / 64.0)) AS BIGINT) AS class FROM vocab, nv UNION ALL SELECT 0, -1),
cw AS (SELECT id, class, count(*) OVER (PARTITION BY class) AS size FROM cl), u AS (SELECT token AS id, count(*) AS c FROM train GROUP BY 1), k AS (SELECT class, sum(c) AS cc FROM u JOIN cw USING (id) GROUP BY 1),
l AS (SELECT x, id FROM (SELECT token AS x, lead(token) OVER (ORDER BY pos) AS id FROM train) WHERE id IS NOT NULL), f AS (SELECT x, class, count(*) AS cxc FROM l JOIN cw USING (id) GROUP BY 1, 2), b AS (SELECT x, count(*) AS cx FROM l GROUP BY 1),
t AS (SELECT lag(token) OVER (ORDER BY pos) AS x, token AS id FROM test),
sc AS (SELECT CASE WHEN cx IS NULL THEN (coalesce(cc, 0) + 0.05) / (total + 0.05 * 65) ELSE (coalesce(cxc, 0) + 0.05) / (cx + 0.05 * 65) END AS pc, (coalesce(c, 0) + 0.05) / (coalesce(cc, 0) + 0.05 * size) AS pw, cx IS NOT NULL AS seen
  FROM t JOIN cw USING (id) LEFT JOIN u USING (id) LEFT JOIN k USING (class) LEFT JOIN b USING (x) LEFT JOIN f USING (x, class) CROSS JOIN (SELECT count(*) AS total FROM train) WHERE x IS NOT NULL)
SELECT count(*) AS n, round(exp(avg(-ln(pc))), 6) AS ppl_class, round(exp(avg(-ln(pw))), 6) AS ppl_in_class, round(exp(avg(-ln(pc * pw))), 6) AS ppl_word, round(avg(CAST(seen AS DOUBLE)), 9) AS known FROM sc""")
def class_model(spark, sf):
    v, train, test = _id_parts(spark, sf)
    return classmodel.report(classmodel.cases(train, test, vocab.classes(v, 64), 64))


_SUCC = f"""{q.TOKENS.replace("tok AS MATERIALIZED", "tok AS")}, {q.parts("tok").replace("AS MATERIALIZED", "AS")},
ng AS (SELECT token AS a, lead(token, 1) OVER (ORDER BY pos) AS b, lead(token, 2) OVER (ORDER BY pos) AS c FROM train),
sc AS (SELECT 0 AS len, '' AS context, a AS word, count(*) AS cnt FROM ng GROUP BY 1, 2, 3 UNION ALL SELECT 1, a, b, count(*) FROM ng WHERE b IS NOT NULL GROUP BY 1, 2, 3 UNION ALL SELECT 2, a || ' ' || b, c, count(*) FROM ng WHERE c IS NOT NULL GROUP BY 1, 2, 3),
iv AS MATERIALIZED (SELECT len, context, word, sum(cnt) OVER (PARTITION BY len, context ORDER BY cnt DESC, word ROWS UNBOUNDED PRECEDING) AS hi, cnt FROM sc),
tt AS MATERIALIZED (SELECT len, context, sum(cnt) AS total FROM sc GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {_SUCC},
sd AS (SELECT doc_id AS chain, list(token ORDER BY i) AS seen FROM tok WHERE i < 2 GROUP BY doc_id),
rec(chain, step, seen, words, backed) AS (SELECT chain, 0, seen, CAST([] AS VARCHAR[]), 0 FROM sd UNION ALL
  SELECT k.chain, k.step + 1, list_append(k.seen, iv.word)[-2:], list_append(k.words, iv.word), k.backed + CASE WHEN k.len < 2 THEN 1 ELSE 0 END
  FROM (SELECT r.*, CASE WHEN t2.total IS NOT NULL THEN 2 WHEN t1.total IS NOT NULL THEN 1 ELSE 0 END AS len, CASE WHEN t2.total IS NOT NULL THEN t2.context WHEN t1.total IS NOT NULL THEN t1.context ELSE '' END AS context,
      floor({q.unit_draw("'0:' || r.chain || ':' || r.step")} * coalesce(t2.total, t1.total, t0.total)) AS at
    FROM rec r LEFT JOIN tt t2 ON t2.len = 2 AND len(r.seen) = 2 AND t2.context = r.seen[1] || ' ' || r.seen[2] LEFT JOIN tt t1 ON t1.len = 1 AND t1.context = r.seen[-1] JOIN tt t0 ON t0.len = 0 WHERE r.step < 24) k
  JOIN iv ON iv.len = k.len AND iv.context = k.context AND iv.hi - iv.cnt <= k.at AND k.at < iv.hi)
SELECT chain, list_aggregate(words, 'string_agg', ' ') AS text, backed FROM rec WHERE step = 24""")
def generated_words(spark, sf):
    """For each document, 24 words drawn after its first two by counts of the train part, with two words of context."""
    train, _ = _stored_parts(spark, sf)
    seeds = _words(spark, sf).where(F.size("tokens") > 0).select(F.col("doc_id").alias("chain"), F.slice("tokens", 1, 2).alias("context"))
    return generation.drawn(seeds, *generation.packed_successors(train))


_ROUNDS, _RATE = 5, 4.0


def _softmax_sql() -> str:
    out = ["""v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = 64),
x AS MATERIALIZED (SELECT vec_id, label, unnest(range(0, 65)) AS i, CAST(unnest(list_append(list_transform(e, lambda a: round_even(a * 4096, 0)), 4096.0)) AS BIGINT) AS q FROM v),
n AS (SELECT count(*) AS n FROM v WHERE vec_id % 5 <> 0), w0 AS (SELECT unnest(range(0, 65)) AS i, c, CAST(0 AS DOUBLE) AS w FROM range(0, 10) t(c))"""]
    for r in range(_ROUNDS):
        out.append(f"""z{r} AS (SELECT vec_id, any_value(label) AS label, c, sum(q * w) / 4096 AS z FROM x JOIN w{r} USING (i) WHERE vec_id % 5 <> 0 GROUP BY vec_id, c),
e{r} AS MATERIALIZED (SELECT vec_id, c, CAST(round_even((exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY vec_id) - CASE WHEN c = label THEN 1 ELSE 0 END) * 262144, 0) AS BIGINT) AS e FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM z{r})),
w{r + 1} AS MATERIALIZED (SELECT i, c, w - {_RATE} * CAST(g AS DOUBLE) * (1.0 / 4096 / 262144 / n) AS w FROM (SELECT i, c, sum(q * e) AS g FROM x JOIN e{r} USING (vec_id) GROUP BY 1, 2) JOIN w{r} USING (i, c), n)""")
    out.append(f"zt AS (SELECT vec_id, any_value(label) AS label, c, sum(q * w) / 4096 AS z FROM x JOIN w{_ROUNDS} USING (i) WHERE vec_id % 5 = 0 GROUP BY vec_id, c), pr AS MATERIALIZED (SELECT vec_id, label, c AS pred FROM zt QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(z, 9) DESC, c) = 1)")
    return ", ".join(out)


@query(f"""WITH {_softmax_sql()}, c AS (SELECT DISTINCT label AS class FROM embeddings), r AS (SELECT label AS class, count(*) AS support, count(*) FILTER (label = pred) AS hit FROM pr GROUP BY 1), s AS (SELECT pred AS class, count(*) AS said FROM pr GROUP BY 1),
m AS (SELECT c.class, coalesce(hit / CAST(nullif(support, 0) AS DOUBLE), 0) AS recall, coalesce(hit / CAST(nullif(said, 0) AS DOUBLE), 0) AS "precision", coalesce(support, 0) AS support FROM c LEFT JOIN r USING (class) LEFT JOIN s USING (class))
SELECT class, round(recall, 9) AS recall, round("precision", 9) AS "precision", round(coalesce(2 * recall * "precision" / nullif(recall + "precision", 0), 0), 9) AS f1, support FROM m""")
def linear_classifier(spark, sf):
    """A softmax model of the labels of four vectors in five, reported on the fifth."""
    e = table(spark, sf, "embeddings")
    w = learners.fit_softmax(e.where(_MEMORY), "embedding", "label", 64, 10, _ROUNDS, _RATE)
    got = learners.classified(e.where(_QUERY).withColumn("label", F.col("label").cast("int")), "embedding", w, "vec_id", "label")
    return metrics.per_class(got.select(F.col("vec_id").alias("query_id"), "label", "pred"), _classes(spark, sf))


@query()
def dictionary_codes(spark, sf):
    """Each vector's best of 32 codewords over 16 whitened directions, its match, and how many codewords are above the mean."""
    e = table(spark, sf, "embeddings")
    own = learners.fit_dictionary(e, "embedding", "vec_id", 64, 16, 32)
    if own is None:
        return spark.createDataFrame([], "vec_id long, word int, match double, active long")
    active = F.size(F.filter("code", lambda x: x > 0)).cast("long")
    return learners.encoded(e, "embedding", "vec_id", 64, own).select(F.col("id").alias("vec_id"), "word", F.round("match", 6).alias("match"), active.alias("active"))


@query(f"""WITH {_IDS}, un AS (SELECT token, count(*) AS c FROM train GROUP BY 1), ut AS (SELECT count(*) AS n FROM train),
n AS (SELECT count(*) AS n FROM test), b AS (SELECT n, unnest(range(0, n - 1, 256)) AS b FROM n WHERE n >= 2), w AS (SELECT b, n, CASE WHEN b = 0 THEN 1 ELSE b + 256 END AS lo, least(b + 512, n) AS hi FROM b WHERE b = 0 OR b + 256 < n)
SELECT w.b AS "begin", count(*) AS scored, round(sum(-ln((coalesce(un.c, 0) + 0.05) / (ut.n + 0.05 * 65536))), 4) AS nll FROM w CROSS JOIN ut JOIN test t ON t.pos >= w.lo AND t.pos < w.hi LEFT JOIN un ON un.token = t.token GROUP BY 1""")
def scored_windows(spark, sf):
    """Strided windows of ids through a registered scorer."""
    _, train, test = _id_parts(spark, sf)
    got = scoring.strided_losses(test, scoring.SCORERS["unigram"](train), 512, 256)
    return got.select("begin", "scored", F.round("nll", 4).alias("nll"))


@query(f"""WITH {_KEYWORDS}, cd AS (SELECT kw.doc_id, key, margin FROM kw JOIN post USING (key, doc_id)),
hx AS (SELECT doc_id, margin, [{", ".join(f"CAST('0x' || substr(md5(key), {8 * g + 1}, 8) AS BIGINT)" for g in range(4))}] AS h FROM cd),
sj AS (SELECT doc_id, j, sum(CASE WHEN (h[j // 32 + 1] >> (j % 32)) & 1 = 1 THEN margin ELSE -margin END) AS s FROM hx, range(0, 128) t(j) GROUP BY 1, 2),
rl AS MATERIALIZED (SELECT doc_id, list(CAST(s AS DOUBLE) ORDER BY j) AS s FROM sj GROUP BY 1), bd AS MATERIALIZED (SELECT doc_id, j // 16 AS band, sum(CASE WHEN s >= 0 THEN 1 << CAST(j % 16 AS INTEGER) ELSE 0 END) AS value FROM sj GROUP BY 1, 2),
pr AS (SELECT DISTINCT a.doc_id AS query_id, b.doc_id FROM bd a JOIN bd b USING (band, value) WHERE a.doc_id % 20 = 0 AND a.doc_id <> b.doc_id),
cs AS (SELECT query_id, pr.doc_id, round(list_dot_product(a.s, b.s) / (sqrt(list_dot_product(a.s, a.s)) * sqrt(list_dot_product(b.s, b.s))), 9) AS cos FROM pr JOIN rl a ON a.doc_id = query_id JOIN rl b ON b.doc_id = pr.doc_id)
SELECT query_id, rank, doc_id, cos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, doc_id) AS rank FROM cs) WHERE rank <= 5""")
def relay_recall(spark, sf):
    """The five documents whose relays are nearest to each twentieth's, by the keywords that the postings hold."""
    codes = similarity.postings(_words(spark, sf)).select("doc_id", "key", "margin")
    return relay.near(codes, F.col("doc_id") % 20 == 0, 5)


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {q.unit_draw("'5:' || doc_id")}, doc_id) - 1 AS place FROM documents")
def shuffled_rows(spark, sf):
    """Each document's place in a seeded order, without a sort in one task."""
    return sampling.shuffled(_docs(spark, sf).select("doc_id"), "doc_id", 5)


@query(f"""WITH {q.CLEAN}, r AS (SELECT conv_id, count(*) AS turns, bool_and(role IN ('system', 'user', 'assistant', 'tool')) AS known FROM conversations GROUP BY 1),
k AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS a FROM clean GROUP BY 1),
o AS (SELECT CAST(conv_id % 4 AS BIGINT) AS kind, conv_id % 4 <> 3 AND turns >= 2 AND known AND coalesce(a, 0) > 0 AS ok FROM r LEFT JOIN k USING (conv_id))
SELECT kind, count(*) AS tried, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS failed, round(count(*) FILTER (ok) / CAST(count(*) AS DOUBLE), 9) AS rate FROM o GROUP BY 1""")
def reply_report(spark, sf):
    """How many replies of each kind of wrapping were tried, accepted and lost."""
    rows = _replies(spark, sf).select(F.pmod("conv_id", F.lit(4)).alias("kind"), chat.parsed(F.col("reply")).alias("m"))
    return metrics.run_report(rows, "kind", F.col("m").isNotNull())
