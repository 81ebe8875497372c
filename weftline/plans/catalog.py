"""Registry of queries and of the SQL that states the same for another engine.

Each query takes (spark, sf_dir) and runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.schedules import cosine_anneal, inverse_decay, warmup_steps
from ..functions.text import approx_tokens, clock, safe_name, unit_draw, words
from ..operators import chat, metrics, ngrams, sampling, similarity, suffixes, tokens, vocab
from ..operators.lineage import cut, scratch
from ..sources.readers import jsonl, table
from . import sqltext as q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _stream(spark: SparkSession, sf: str, separator: str | None = None, led: bool = False) -> DataFrame:
    return tokens.stream(_docs(spark, sf), separator, led=led)


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and tokens, for queries that need no positions."""
    return _docs(spark, sf).select("doc_id", words(F.col("text")).alias("tokens"))


def _ids(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The vocabulary, and the led stream of its ids, made once and written."""
    v, path = cut(_vocab(_words(spark, sf))), scratch(spark, "ids")
    s = vocab.mapped_stream(_stream(spark, sf, led=True), v)
    s.write.parquet(path)
    return v, spark.read.schema(s.schema).parquet(path)


def _vocab(s: DataFrame) -> DataFrame:
    return vocab.top(vocab.frequencies(s))


def _parts(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    p = tokens.split(s)
    return p.where("part = 'train'"), p.where("part = 'test'")


def _stored_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The led stream, made once and written, for queries that read it several times."""
    path, s = scratch(spark, "stream"), _stream(spark, sf, led=True)
    s.write.parquet(path)
    return spark.read.schema(s.schema).parquet(path)


def _stored_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The same of the led stream, made once and written."""
    path = scratch(spark, "parts")
    tokens.split(_stream(spark, sf, led=True)).write.parquet(path)
    p = spark.read.schema("part string, doc_id long, start long, tokens array<string>, lead array<string>, n long").parquet(path)
    return p.where("part = 'train'"), p.where("part = 'test'")


def _convs(spark: SparkSession, sf: str) -> DataFrame:
    return chat.conversations(table(spark, sf, "conversations"))


# ---- projections and vocabularies


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''")
def text_project(spark, sf):
    return _docs(spark, sf).where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text")


@query(f"WITH {q.TOKENS}, {q.FREQ} SELECT word, freq FROM freq")
def word_freq(spark, sf):
    return vocab.frequencies(_words(spark, sf))


@query(f"WITH {q.TOKENS}, {q.FREQ}, {q.VOCAB} SELECT id, word, freq FROM vocab")
def top_vocab(spark, sf):
    return _vocab(_words(spark, sf))


@query(f"WITH {q.TOKENS}, {q.FREQ}, {q.VOCAB}, k AS (SELECT sum(freq) AS known, count(*) + 1 AS vocab FROM vocab), a AS (SELECT sum(freq) AS n FROM freq) SELECT n AS n_tokens, vocab, n - known AS n_unknown, round((n - known) / CAST(n AS DOUBLE), 9) AS unknown FROM a, k")
def corpus_stats(spark, sf):
    freqs = vocab.frequencies(_words(spark, sf))
    known = vocab.top(freqs).agg(F.sum("freq").alias("known"), (F.count("*") + 1).alias("vocab"))
    got = freqs.agg(F.sum("freq").alias("n_tokens")).crossJoin(known)
    rest = F.col("n_tokens") - F.col("known")
    return got.select("n_tokens", "vocab", rest.alias("n_unknown"), F.round(rest / F.col("n_tokens").cast("double"), 9).alias("unknown"))


@query(f"WITH {q.TOKENS}, {q.FREQ}, {q.VOCAB}, {q.IDS} SELECT pos, doc_id, token AS id FROM ids")
def map_ids(spark, sf):
    return vocab.mapped(_stream(spark, sf), _vocab(_words(spark, sf)))


@query(f"WITH {q.TOKENS}, {q.FREQ}, {q.VOCAB}, v AS (SELECT count(*) AS v FROM vocab) SELECT id, word, freq, CAST(floor((id - 1) / ceil(v / 64.0)) AS BIGINT) AS class, CAST((id - 1) % ceil(v / 64.0) AS BIGINT) AS slot FROM vocab, v")
def freq_classes(spark, sf):
    return vocab.classes(_vocab(_words(spark, sf)), 64)


# ---- token streams


@query(f"WITH {q.SEPARATED} SELECT pos, doc_id, token FROM tok")
def token_stream(spark, sf):
    return tokens.positions(_stream(spark, sf, "<sep>"))


BUDGET = 100_000


@query(f"WITH {q.SEPARATED} SELECT doc_id, min(pos) AS start, count(*) AS n FROM tok WHERE pos < {BUDGET} GROUP BY doc_id")
def budget_clamp(spark, sf):
    return tokens.clamp(_stream(spark, sf, "<sep>"), BUDGET).select("doc_id", "start", "n")


@query(f"WITH {q.SEPARATED}, b AS (SELECT pos // 512 AS block, string_agg(token, ' ' ORDER BY pos) AS s, count(*) AS n FROM tok GROUP BY 1) SELECT block, md5(s) AS digest FROM b WHERE n = 512")
def pack_blocks(spark, sf):
    got = tokens.packed(_stream(spark, sf, "<sep>"), 512)
    return got.select("block", F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


@query(f"WITH {q.TOKENS}, w AS (SELECT pos, string_agg(token, ' ') OVER (ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS c, token FROM tok) SELECT pos, md5(c) AS context, token FROM w WHERE pos >= 8")
def context_windows(spark, sf):
    got = tokens.contexts(_stream(spark, sf, led=True), 8)
    return got.select("pos", F.md5(F.array_join("context", " ").cast("binary")).alias("context"), "token")


@query(f"""WITH {q.TOKENS}, n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
b AS (SELECT doc_id, n, unnest(range(0, n - 1, 256)) AS b FROM n WHERE n >= 2)
SELECT doc_id, b AS "begin", least(b + 512, n) AS "end", least(b + 512, n) - CASE WHEN b = 0 THEN 1 ELSE b + 256 END AS scored FROM b WHERE b = 0 OR b + 256 < n""")
def strided_windows(spark, sf):
    got = _stream(spark, sf).select("doc_id", F.inline(tokens.strided(F.col("n"), 512, 256)))
    return got.select("doc_id", "begin", "end", F.col("scored").cast("long").alias("scored"))


@query(f"""WITH {q.TOKENS}, n AS (SELECT count(*) AS n FROM tok), r AS (SELECT unnest(range(0, 4)) AS rank, n FROM n),
l AS (SELECT rank, n, rank * n // 4 AS lo, (rank + 1) * n // 4 - 33 AS hi FROM r)
SELECT CAST(rank AS INTEGER) AS rank, CASE WHEN hi <= lo THEN 0 ELSE lo END AS lo, CASE WHEN hi <= lo THEN greatest(1, n - 33) ELSE hi END AS hi FROM l""")
def rank_shards(spark, sf):
    return tokens.length(_stream(spark, sf)).select(F.inline(tokens.shards(F.col("total"), 4, 33)))


@query(f"""WITH {q.TOKENS}, {q.parts('tok')}, p AS (SELECT 'train' AS part, * FROM train UNION ALL SELECT 'test', * FROM test)
SELECT part, count(*) AS n, count(DISTINCT token) AS words, arg_min(token, pos) AS first, arg_max(token, pos) AS last FROM p GROUP BY part""")
def split_90_10(spark, sf):
    p = tokens.split(_stream(spark, sf))
    at = p.select("part", "start", F.posexplode("tokens").alias("i", "token")).withColumn("pos", F.col("start") + F.col("i"))
    return at.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("token").alias("words"), F.min_by("token", "pos").alias("first"), F.max_by("token", "pos").alias("last"))


@query(f"""WITH {q.TOKENS}, c AS (SELECT pos, token, row_number() OVER (PARTITION BY token ORDER BY pos) - 1 AS k FROM tok)
SELECT doc_id, count(*) AS n, round(sum(-ln((k + 0.1) / (c.pos + 0.1 * 4096))), 4) AS nll FROM c JOIN tok USING (pos) GROUP BY doc_id""")
def adaptive_unigram(spark, sf):
    got = ngrams.causal_unigram(_stream(spark, sf), 0.1, 4096)
    return got.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum(-F.log("p")), 4).alias("nll"))


# ---- n-grams


@query(f"""WITH {q.TOKENS}, g AS (SELECT token AS a, lead(token, 1) OVER (ORDER BY pos) AS b, lead(token, 2) OVER (ORDER BY pos) AS c FROM tok)
SELECT 1 AS n, a AS gram, count(*) AS cnt FROM g GROUP BY a UNION ALL SELECT 2, a || ' ' || b, count(*) FROM g WHERE b IS NOT NULL GROUP BY a, b
UNION ALL SELECT 3, a || ' ' || b || ' ' || c, count(*) FROM g WHERE c IS NOT NULL GROUP BY a, b, c""")
def ngram_counts(spark, sf):
    return ngrams.string_counts(_stream(spark, sf, led=True), 3)


_BASE = f"""{q.TOKENS}, {q.FREQ}, {q.VOCAB}, {q.IDS}, {q.parts('ids')},
u AS (SELECT token AS a, count(*) AS c1 FROM train GROUP BY 1),
l AS (SELECT token AS a, lead(token, 1) OVER (ORDER BY pos) AS b, lead(token, 2) OVER (ORDER BY pos) AS c FROM train),
bi AS (SELECT a, b, count(*) AS c2 FROM l WHERE b IS NOT NULL GROUP BY 1, 2), tri AS (SELECT a, b, c, count(*) AS c3 FROM l WHERE c IS NOT NULL GROUP BY 1, 2, 3),
nn AS (SELECT (SELECT count(*) FROM train) AS total, (SELECT count(*) + 1 FROM vocab) AS v),
x AS (SELECT pos, lag(token, 2) OVER (ORDER BY pos) AS wp, lag(token, 1) OVER (ORDER BY pos) AS wl, token AS y FROM test),
s AS (SELECT x.pos, x.y, (coalesce(uy.c1, 0) + 0.05) / (total + 0.05 * v) AS pu, (coalesce(b1.c2, 0) + 0.05) / (coalesce(ul.c1, 0) + 0.05 * v) AS pb,
  (coalesce(t.c3, 0) + 0.05) / (coalesce(b2.c2, 0) + 0.05 * v) AS pt, coalesce(b2.c2, 0) > 0 AS seen
  FROM x CROSS JOIN nn LEFT JOIN u uy ON uy.a = x.y LEFT JOIN u ul ON ul.a = x.wl LEFT JOIN bi b1 ON b1.a = x.wl AND b1.b = x.y
  LEFT JOIN bi b2 ON b2.a = x.wp AND b2.b = x.wl LEFT JOIN tri t ON t.a = x.wp AND t.b = x.wl AND t.c = x.y WHERE x.pos >= 8),
scored AS MATERIALIZED (SELECT *, 0.1 * pu + 0.3 * pb + 0.6 * pt AS pi FROM s)"""
_BASELINES = """SELECT count(*) AS n, round(exp(avg(-ln(pu))), 6) AS ppl_unigram, round(exp(avg(-ln(pb))), 6) AS ppl_bigram, round(exp(avg(-ln(pt))), 6) AS ppl_trigram,
round(exp(avg(-ln(pi))), 6) AS ppl_interpolated, round(avg(CAST(seen AS DOUBLE)), 9) AS coverage FROM scored"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    v, s = _ids(spark, sf)  # written once, as the counts and the test read it again and again
    train, test = _parts(s)
    return ngrams.baseline_cases(train, test, v.count() + 1, 8)


@query(f"WITH {_BASE} {_BASELINES}")
def ngram_baselines(spark, sf):
    return ngrams.baselines(_scored(spark, sf))


@query(f"""WITH {_BASE}, b AS ({_BASELINES}) SELECT row_number() OVER (ORDER BY ppl NULLS LAST, seq) AS place, model, ppl, error FROM (
SELECT 1 AS seq, 'unigram' AS model, ppl_unigram AS ppl, NULL AS error FROM b UNION ALL SELECT 2, 'bigram', ppl_bigram, NULL FROM b UNION ALL SELECT 3, 'trigram', ppl_trigram, NULL FROM b
UNION ALL SELECT 4, 'interpolated', ppl_interpolated, NULL FROM b UNION ALL SELECT 5, 'absent', NULL, 'no such model')""")
def scoreboard(spark, sf):
    b = ngrams.baselines(_scored(spark, sf))
    names = ("unigram", "bigram", "trigram", "interpolated")
    rows = [F.struct(F.lit(i + 1).alias("seq"), F.lit(m).alias("model"), F.col(f"ppl_{m}").alias("ppl"), F.lit(None).cast("string").alias("error")) for i, m in enumerate(names)]
    rows.append(F.struct(F.lit(5).alias("seq"), F.lit("absent").alias("model"), F.lit(None).cast("double").alias("ppl"), F.lit("no such model").alias("error")))
    return metrics.scoreboard(b.select(F.inline(F.array(*rows))))


@query(f"WITH {_BASE} SELECT count(*) AS n, count(*) FILTER (pb > pt * 1.001) AS a_wins, count(*) FILTER (pt > pb * 1.001) AS b_wins, count(*) FILTER (NOT pb > pt * 1.001 AND NOT pt > pb * 1.001) AS ties FROM scored")
def head_to_head(spark, sf):
    return metrics.head_to_head(_scored(spark, sf), "pb", "pt", times="times")


def _suffix_sql(most: int) -> str:
    lags = ", ".join(f"lag(token, {k}) OVER w AS l{k}" for k in range(1, most + 1))
    ctx = ", ".join(["l1 AS c1", *[f"l{n} || ' ' || c{n - 1} AS c{n}" for n in range(2, most + 1)]])
    every = ", ".join(f"c{n}" for n in range(1, most + 1))
    cases = lambda src: f"SELECT pos, y, unnest([{every}]) AS context, unnest(range(1, {most + 1})) AS len FROM (SELECT pos, y, {ctx} FROM (SELECT pos, token AS y, {lags} FROM {src} WINDOW w AS (ORDER BY pos)))"
    return f"""{q.TOKENS}, {q.parts('tok')},
full_ AS MATERIALIZED (SELECT context, len, y, count(*) AS yes FROM ({cases('train')}) WHERE context IS NOT NULL GROUP BY 1, 2, 3),
tot AS (SELECT context, len, sum(yes) AS tot FROM full_ GROUP BY 1, 2),
hit AS (SELECT c.pos, c.y, c.len, c.context, tot FROM ({cases('test')}) c JOIN tot USING (context, len) QUALIFY row_number() OVER (PARTITION BY pos ORDER BY c.len DESC) = 1),
sfx AS MATERIALIZED (SELECT t.pos, t.token AS y, CAST(coalesce(h.len, 0) AS INTEGER) AS matched, CAST(coalesce(h.tot, 0) AS BIGINT) AS tot, coalesce(f.yes, 0) AS yes,
  CASE WHEN h.len IS NULL THEN 1.0 / 65536 ELSE (coalesce(f.yes, 0) + 1e-6) / (h.tot + 1e-6 * 65536) END AS p
  FROM test t LEFT JOIN hit h USING (pos) LEFT JOIN full_ f ON f.context = h.context AND f.len = h.len AND f.y = t.token)"""


@query(f"WITH {_suffix_sql(suffixes.MOST)} SELECT pos, y, matched, tot, yes, round(p, 12) AS p FROM sfx")
def infini_gram(spark, sf):
    train, test = _stored_parts(spark, sf)
    return suffixes.longest_suffix(train, test).withColumn("p", F.round("p", 12))


_UNI = "un AS (SELECT token, count(*) AS c FROM train GROUP BY 1), ut AS (SELECT count(*) AS n FROM train)"


@query(f"""WITH {_suffix_sql(suffixes.MOST)}, {_UNI}, l AS (SELECT unnest([0.1, 0.2, 0.3, 0.5, 0.7, 0.9]) AS lam)
SELECT CAST(lam AS DOUBLE) AS "lambda", count(*) AS n, round(exp(avg(-ln((1 - lam) * (coalesce(c, 0) + 0.05) / (n + 0.05 * 65536) + lam * p + 1e-30))), 6) AS ppl
FROM sfx CROSS JOIN ut CROSS JOIN l LEFT JOIN un ON un.token = sfx.y GROUP BY lam""")
def lambda_sweep(spark, sf):
    train, test = _stored_parts(spark, sf)
    got = suffixes.longest_suffix(train, test)
    rows = got.groupBy("y", F.col("p").alias("pg")).agg(F.count("*").alias("times"))
    uni = train.select(F.explode("tokens").alias("y")).groupBy("y").agg(F.count("*").alias("c"))
    total = F.broadcast(train.agg(F.sum("n").alias("total")))
    pb = (F.coalesce("c", F.lit(0)) + 0.05) / (F.col("total") + 0.05 * 65536)
    return ngrams.sweep(rows.join(uni, "y", "left").crossJoin(total).withColumn("pb", pb), "pb", "pg", times="times")


@query(f"""WITH {q.TOKENS}, {q.parts('tok')}, {_UNI},
n AS (SELECT count(*) AS n FROM test), b AS (SELECT n, unnest(range(0, n - 1, 256)) AS b FROM n WHERE n >= 2), w AS (SELECT b, n, CASE WHEN b = 0 THEN 1 ELSE b + 256 END AS lo, least(b + 512, n) AS hi FROM b WHERE b = 0 OR b + 256 < n)
SELECT w.b AS "begin", count(*) AS scored, round(sum(-ln((coalesce(un.c, 0) + 0.05) / (ut.n + 0.05 * 65536))), 4) AS nll FROM w CROSS JOIN ut JOIN test t ON t.pos >= w.lo AND t.pos < w.hi LEFT JOIN un ON un.token = t.token GROUP BY 1""")
def strided_nll(spark, sf):
    """Strided-window loss with counts as the scorer: each target is scored once, in the window that is first to hold it."""
    train, test = _parts(_stream(spark, sf))
    uni = train.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    total = F.broadcast(train.agg(F.sum("n").alias("total")))
    at = test.select("start", F.posexplode("tokens").alias("i", "token")).withColumn("pos", F.col("start") + F.col("i")).where("pos >= 1")
    begin = F.when(F.col("pos") < 512, 0).otherwise((F.floor((F.col("pos") - 512) / 256) + 1) * 256)
    p = (F.coalesce("c", F.lit(0)) + 0.05) / (F.col("total") + 0.05 * 65536)
    return at.join(uni, "token", "left").crossJoin(total).groupBy(begin.cast("long").alias("begin")).agg(F.count("*").alias("scored"), F.round(F.sum(-F.log(p)), 4).alias("nll"))


_COOC = (
    f"{q.TOKENS}, o AS ("
    + " UNION ALL ".join(f"SELECT token AS a, lag(token, {k}) OVER (ORDER BY pos) AS b FROM tok" for k in range(1, 5))
    + "), both_ AS (SELECT a, b FROM o WHERE b IS NOT NULL UNION ALL SELECT b, a FROM o WHERE b IS NOT NULL), co AS MATERIALIZED (SELECT a, b, count(*) AS cnt FROM both_ GROUP BY 1, 2)"
)


@query(f"WITH {_COOC} SELECT a, b, cnt FROM co")
def cooccurrence(spark, sf):
    return ngrams.cooccurrences(_stored_stream(spark, sf), 4)


@query(f"""WITH {_COOC}, m AS (SELECT a, sum(cnt) AS c FROM co GROUP BY 1), al AS (SELECT sum(cnt) AS n FROM co)
SELECT co.a, co.b, cnt, round(ln(cnt * n / (CAST(m.c AS DOUBLE) * m2.c)), 6) AS pmi FROM co JOIN m ON m.a = co.a JOIN m m2 ON m2.a = co.b CROSS JOIN al WHERE ln(cnt * n / (CAST(m.c AS DOUBLE) * m2.c)) > 0""")
def ppmi(spark, sf):
    s = _stored_stream(spark, sf)
    return ngrams.positive_pmi(s, 4, cut(ngrams.neighbours(s, 4))).withColumn("pmi", F.round("pmi", 6))


@query(f"""WITH {q.TOKENS}, s AS (SELECT pos, {" || ' ' || ".join(f"coalesce(lead(token, {k}) OVER (ORDER BY pos), '')" if k else "token" for k in range(16))} AS suffix FROM tok)
SELECT pos, dense_rank() OVER (ORDER BY suffix) AS rank FROM s""")
def suffix_ranks(spark, sf):
    return ngrams.suffix_ranks(_stored_stream(spark, sf))


@query(f"""WITH {q.TOKENS}, {q.parts('tok')}, v AS (SELECT DISTINCT token FROM train), u AS (SELECT v.token, count(t.token) AS x FROM v LEFT JOIN test t ON t.token = v.token GROUP BY 1),
r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS g FROM u)
SELECT count(*) AS units, round(avg(CASE WHEN x = 0 THEN 1.0 ELSE 0 END), 9) AS dead, round(avg(x), 9) AS mean, round(sum((2 * i - g - 1) * x) / CAST(max(g) * sum(x) AS DOUBLE), 9) AS gini FROM r""")
def usage_gini(spark, sf):
    train, test = _parts(_stream(spark, sf))
    words = train.select(F.explode("tokens").alias("token")).distinct()
    used = test.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("count"))
    return metrics.gini(words.join(used, "token", "left").na.fill(0))


# ---- conversations


@query(f"WITH {q.CLEAN} SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles, md5(string_agg(content, chr(10) ORDER BY turn)) AS digest FROM clean GROUP BY conv_id")
def clean_messages(spark, sf):
    m = _convs(spark, sf).select("conv_id", chat.clean(F.col("messages")).alias("m")).where(F.size("m") > 0)
    return m.select("conv_id", F.size("m").cast("long").alias("n"), F.array_join(F.col("m.role"), ",").alias("roles"), F.md5(F.array_join(F.col("m.content"), "\n").cast("binary")).alias("digest"))


@query(f"""WITH {q.CLEAN}, l AS (SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || content || CASE WHEN role = 'assistant' THEN '<|end|>' ELSE '' END, chr(10) ORDER BY turn) AS t FROM clean WHERE role <> 'tool' GROUP BY conv_id)
SELECT DISTINCT c.conv_id, coalesce(t, '') AS text FROM conversations c LEFT JOIN l USING (conv_id)""")
def chatml_lite(spark, sf):
    return _convs(spark, sf).select("conv_id", chat.chat_lite(F.col("messages")).alias("text"))


@query(f"""WITH {q.CLEAN}, l AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY turn) AS t FROM clean GROUP BY conv_id)
SELECT DISTINCT c.conv_id, coalesce(t, '') AS text FROM conversations c LEFT JOIN l USING (conv_id)""")
def chat_template(spark, sf):
    return _convs(spark, sf).select("conv_id", chat.rendered(F.col("messages")).alias("text"))


_KEYS = "k AS (SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS key FROM conversations GROUP BY conv_id)"
_HELD = f"{_KEYS}, h AS (SELECT conv_id, CAST({q.md5_mod('key', 10)} AS BIGINT) AS bucket FROM k)"


def _held(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.holdout(_convs(spark, sf), chat.first_user(F.col("messages")), 10)


@query(f"WITH {_HELD} SELECT conv_id, bucket, bucket = 0 AS held_out FROM h")
def holdout_split(spark, sf):
    return _held(spark, sf).select("conv_id", "bucket", "held_out")


@query(f"WITH {_HELD}, e AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS r FROM h WHERE bucket = 0) SELECT h.conv_id, CASE WHEN r IS NULL THEN 'train' WHEN r <= 3 THEN 'eval' ELSE 'none' END AS part FROM h LEFT JOIN e USING (conv_id)")
def holdout_cap(spark, sf):
    return sampling.capped_split(_held(spark, sf), "conv_id", 3).select("conv_id", "part")


@query(f"WITH {_HELD} SELECT count(*) FILTER (bucket <> 0) AS train, count(*) FILTER (bucket = 0) AS eval, (SELECT count(*) FROM (SELECT DISTINCT a.key FROM k a JOIN h ha USING (conv_id) JOIN k b ON a.key = b.key JOIN h hb ON hb.conv_id = b.conv_id WHERE ha.bucket = 0 AND hb.bucket <> 0)) AS shared FROM h")
def holdout_disjoint(spark, sf):
    rows = _held(spark, sf).withColumn("key", F.md5(chat.first_user(F.col("messages")).cast("binary")))
    both = rows.groupBy("key").agg(F.count_if("held_out").alias("e"), F.count_if(~F.col("held_out")).alias("t"))
    return both.agg(F.sum("t").alias("train"), F.sum("e").alias("eval"), F.count_if((F.col("t") > 0) & (F.col("e") > 0)).alias("shared"))


@query(f"SELECT conv_id, CASE WHEN {q.unit_draw('CAST(conv_id AS VARCHAR)')} < 0.5 THEN 'chat' WHEN {q.unit_draw('CAST(conv_id AS VARCHAR)')} < 0.8 THEN 'code' ELSE 'tool' END AS category FROM (SELECT DISTINCT conv_id FROM conversations)")
def weighted_category(spark, sf):
    ids = table(spark, sf, "conversations").select("conv_id").distinct()
    return ids.select("conv_id", sampling.weighted_choice(F.col("conv_id").cast("string"), [("chat", 5.0), ("code", 3.0), ("tool", 2.0)]).alias("category"))


# ---- sources, quotas, interleaving

_SOURCES = [(f"src{i}", float(i % 5 + 1)) for i in range(20)] + [("missing", 7.0)]
_SRC = "src(name, weight, seq) AS (VALUES " + ", ".join(f"('{n}', {w}, {i})" for i, (n, w) in enumerate(_SOURCES)) + ")"
POOL = 400_000
_QUOTA = f"""{_SRC}, live AS (SELECT * FROM src WHERE name IN (SELECT source FROM documents)),
quota AS (SELECT name, seq, weight / sum(weight) OVER () AS weight, CAST(round_even(weight / sum(weight) OVER () * {POOL}, 0) AS BIGINT) AS quota FROM live)"""
_DRAWN = f"""{_QUOTA}, e AS (SELECT source AS name, doc_id, CASE WHEN text <> '' THEN greatest(1, length(text) // 4) ELSE 0 END AS est FROM documents),
r AS (SELECT name, doc_id, est, coalesce(sum(est) OVER (PARTITION BY name ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
drawn AS MATERIALIZED (SELECT r.*, quota, row_number() OVER (PARTITION BY name ORDER BY doc_id) - 1 AS nth FROM r JOIN quota USING (name) WHERE before < quota)"""


def _quotas(spark: SparkSession, sf: str) -> DataFrame:
    src = spark.createDataFrame(_SOURCES, "name string, weight double")
    return sampling.weights(src, _docs(spark, sf).select(F.col("source").alias("name")), POOL)


def _drawn(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select(F.col("source").alias("name"), F.col("doc_id").alias("seq"), "doc_id", "text")
    return sampling.quota_sample(docs, _quotas(spark, sf)).select("name", "seq", "doc_id", "est", "before", "quota")


@query(f"WITH {_QUOTA} SELECT name, round(weight, 9) AS weight, quota FROM quota")
def renormalised_weights(spark, sf):
    return _quotas(spark, sf).select("name", F.round("weight", 9).alias("weight"), "quota")


@query(f"WITH {_DRAWN} SELECT name, doc_id, est, CAST(before AS BIGINT) AS before FROM drawn")
def quota_sample(spark, sf):
    return _drawn(spark, sf).select("name", "doc_id", F.col("est").cast("long").alias("est"), F.col("before").cast("long").alias("before"))


@query(f"WITH {_DRAWN} SELECT q.name, q.quota, count(d.doc_id) AS docs, CAST(coalesce(sum(est), 0) AS BIGINT) AS written, coalesce(sum(est), 0) < q.quota AS exhausted FROM quota q LEFT JOIN drawn d USING (name) GROUP BY q.name, q.quota")
def source_report(spark, sf):
    got = _drawn(spark, sf).groupBy("name").agg(F.count("*").alias("docs"), F.sum("est").cast("long").alias("written"))
    return _quotas(spark, sf).select("name", "quota").join(got, "name", "left").na.fill(0).withColumn("exhausted", F.col("written") < F.col("quota"))


@query(f"""WITH {_DRAWN}, s AS (SELECT q.name, q.seq, q.weight, coalesce(sum(est), 0) AS written FROM quota q LEFT JOIN drawn d USING (name) GROUP BY ALL)
SELECT 'words' AS model, {POOL} AS pool_tokens, CAST(sum(written) AS BIGINT) AS train_tokens, count(*) AS n_sources, (SELECT max(doc_id) FROM drawn) AS max_doc, string_agg(name || ':' || CAST(written AS BIGINT), ',' ORDER BY name) AS sources FROM s""")
def blend_manifest(spark, sf):
    d = _drawn(spark, sf)
    per = _quotas(spark, sf).join(d.groupBy("name").agg(F.sum("est").cast("long").alias("written"), F.max("doc_id").alias("m")), "name", "left").na.fill(0, ["written"])
    return per.agg(F.lit("words").alias("model"), F.lit(POOL).alias("pool_tokens"), F.sum("written").alias("train_tokens"), F.count("*").alias("n_sources"), F.max("m").alias("max_doc"), F.array_sort(F.collect_list(F.struct("name", "written"))).alias("__s")).select("model", "pool_tokens", "train_tokens", "n_sources", "max_doc", F.array_join(F.transform("__s", lambda s: F.concat_ws(":", s["name"], s["written"])), ",").alias("sources"))


@query(f"""WITH RECURSIVE {_DRAWN}, o AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS i, name FROM quota), c AS (SELECT i, name, (SELECT count(*) FROM drawn d WHERE d.name = o.name) AS n FROM o),
z AS (SELECT count(*) AS k, sum(n) AS total FROM c),
st(turn, act, served, place, who, nth) AS (
  SELECT CAST(0 AS BIGINT), (SELECT list(i ORDER BY i) FROM c), (SELECT list(CAST(0 AS BIGINT) ORDER BY i) FROM c), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT)
  UNION ALL SELECT turn + 1, CASE WHEN more THEN act ELSE list_filter(act, lambda x: x <> me) END,
    CASE WHEN more THEN list_concat(list_concat(served[1:me], [served[me + 1] + 1]), served[me + 2:]) ELSE served END,
    place + CASE WHEN more THEN 1 ELSE 0 END, CASE WHEN more THEN me ELSE -1 END, CASE WHEN more THEN served[me + 1] ELSE -1 END
  FROM (SELECT s.*, s.act[s.turn % len(s.act) + 1] AS me, s.served[s.act[s.turn % len(s.act) + 1] + 1] < (SELECT n FROM c WHERE c.i = s.act[s.turn % len(s.act) + 1]) AS more FROM st s WHERE len(s.act) > 0))
SELECT d.doc_id, d.name, st.place FROM st JOIN c ON c.i = st.who JOIN drawn d ON d.name = c.name AND d.nth = st.nth""")
def round_robin(spark, sf):
    d = sampling.numbered(_drawn(spark, sf), "name", "seq")
    live = {r.name for r in _quotas(spark, sf).select("name").collect()}  # at most one row for each configured source
    return sampling.round_robin(d, [n for n, _ in _SOURCES if n in live]).select("doc_id", "name", "place")


@query("SELECT quality, doc_id, pick FROM (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS pick FROM labels) WHERE pick <= 50")
def stratified_sample(spark, sf):
    return sampling.stratified(table(spark, sf, "labels"), "quality", "doc_id", 50).select("quality", "doc_id", "pick")


@query("""WITH t AS (SELECT unnest(range(0, 25)) AS trial, doc_id, quality, toxic FROM labels),
p AS (SELECT trial, quality, toxic, row_number() OVER (PARTITION BY trial, quality ORDER BY md5(trial || ':' || doc_id), doc_id) AS pick FROM t), m AS (SELECT trial, avg(toxic) AS m FROM p WHERE pick <= 10 GROUP BY trial)
SELECT count(*) AS trials, round(avg(m), 9) AS mean, round(stddev_pop(m), 9) AS sd FROM m""")
def few_shot_trials(spark, sf):
    got = sampling.trials(table(spark, sf, "labels"), "quality", "doc_id", 10, 25).groupBy("trial").agg(F.avg("toxic").alias("m"))
    return got.agg(F.count("*").alias("trials"), F.round(F.avg("m"), 9).alias("mean"), F.round(F.stddev_pop("m"), 9).alias("sd"))


@query("SELECT b.item_id, count(d.doc_id) AS n_docs, count(d.doc_id) > 0 AS leaked FROM benchmark b LEFT JOIN documents d ON md5(d.text) = md5(b.text) GROUP BY b.item_id")
def contamination(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.md5(F.col("text").cast("binary")).alias("h"))
    d = _docs(spark, sf).groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.count("*").alias("n"))
    return b.join(d, "h", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_docs"), F.col("n").isNotNull().alias("leaked"))


# ---- similarity and metrics

_QUERY, _MEMORY = "vec_id % 5 = 0", "vec_id % 5 <> 0"
_COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"
_NEAR = f"""sims AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, round({_COS}, 12) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0),
near AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM sims QUALIFY rank <= 15)"""


def _votes_sql(k: int, name: str) -> str:
    return f"""w{k} AS (SELECT query_id, label, sum(greatest(sim, 0)) AS w FROM near WHERE rank <= {k} GROUP BY 1, 2),
v{k} AS MATERIALIZED (SELECT query_id, label, coalesce(w / nullif(sum(w) OVER (PARTITION BY query_id), 0), 0) AS p FROM w{k}),
{name} AS MATERIALIZED (SELECT query_id, label AS pred, p, e.label_ AS label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, label) AS r FROM v{k}) JOIN (SELECT vec_id, label AS label_ FROM embeddings) e ON e.vec_id = query_id WHERE r = 1)"""


_PRED = f"{_NEAR}, {_votes_sql(10, 'pred10')}"


def _near(spark: SparkSession, sf: str, k: int = 15) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return similarity.nearest(e.where(_QUERY), e.where(_MEMORY), k)


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where(_QUERY).select(F.col("vec_id").alias("query_id"), F.col("label").cast("int").alias("label"))


def _pred(spark: SparkSession, sf: str, k: int, near: DataFrame | None = None) -> DataFrame:
    near = _near(spark, sf) if near is None else near
    return _truth(spark, sf).join(similarity.predictions(similarity.votes(near, k)), "query_id")


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("label").cast("int").alias("class")).distinct()


@query(f"WITH {_PRED} SELECT query_id, pred, round(p, 9) AS p FROM pred10")
def knn_vote(spark, sf):
    return similarity.predictions(similarity.votes(_near(spark, sf), 10)).select("query_id", "pred", F.round("p", 9).alias("p"))


@query("""WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings), x AS (SELECT unnest(range(0, len(e))) AS i, unnest(e) / n AS x FROM u WHERE n > 0),
s AS (SELECT i, sum(x) AS s FROM x GROUP BY i), c AS (SELECT count(*) AS n FROM u WHERE n > 0) SELECT c.n, round(((SELECT sum(s * s) FROM s) - c.n) / CAST(c.n * (c.n - 1) AS DOUBLE), 9) AS overlap FROM c""")
def mean_overlap(spark, sf):
    return similarity.mean_overlap(table(spark, sf, "embeddings"))


_KEYWORDS = f"{q.TOKENS}, kw AS MATERIALIZED (SELECT token AS key, doc_id, count(*) AS margin FROM tok GROUP BY 1, 2), post AS MATERIALIZED (SELECT key, doc_id, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS nth FROM kw QUALIFY nth <= 48)"


def _keywords(s: DataFrame) -> DataFrame:
    """key, doc_id, margin: how often each document has each of its words; s: doc_id, tokens."""
    return s.select("doc_id", F.explode("tokens").alias("key")).groupBy("key", "doc_id").agg(F.count("*").alias("margin"))


@query(f"WITH {_KEYWORDS} SELECT key, doc_id, nth FROM post")
def inverted_index(spark, sf):
    return similarity.postings(_words(spark, sf)).select("key", "doc_id", "nth")


@query(f"""WITH {q.TOKENS}, kw AS MATERIALIZED (SELECT token AS key, doc_id, count(*) AS margin FROM tok GROUP BY 1, 2), sc AS (SELECT c.doc_id AS query_id, p.doc_id, sum(c.margin) AS score FROM kw c JOIN kw p USING (key) WHERE c.doc_id % 20 = 0 AND c.doc_id <> p.doc_id GROUP BY 1, 2)
SELECT query_id, rank, doc_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 5""")
def overlap_recall(spark, sf):
    s = _words(spark, sf)
    return similarity.overlaps(s.where(F.col("doc_id") % 20 == 0), s, 5)


@query(f"""WITH {_PRED}, c AS (SELECT DISTINCT label AS class FROM embeddings), r AS (SELECT label AS class, count(*) AS support, count(*) FILTER (label = pred) AS hit FROM pred10 GROUP BY 1), s AS (SELECT pred AS class, count(*) AS said FROM pred10 GROUP BY 1),
m AS (SELECT c.class, coalesce(hit / CAST(nullif(support, 0) AS DOUBLE), 0) AS recall, coalesce(hit / CAST(nullif(said, 0) AS DOUBLE), 0) AS "precision", coalesce(support, 0) AS support FROM c LEFT JOIN r USING (class) LEFT JOIN s USING (class))
SELECT class, round(recall, 9) AS recall, round("precision", 9) AS "precision", round(coalesce(2 * recall * "precision" / nullif(recall + "precision", 0), 0), 9) AS f1, support FROM m""")
def per_class_report(spark, sf):
    return metrics.per_class(_pred(spark, sf, 10), _classes(spark, sf))


@query(f"WITH {_PRED}, c AS (SELECT unnest(range(0, 10)) AS label) SELECT CAST(c.label AS INTEGER) AS label, " + ", ".join(f"count(*) FILTER (pred = {k}) AS p{k}" for k in range(10)) + " FROM c LEFT JOIN pred10 p ON p.label = c.label GROUP BY c.label")
def confusion(spark, sf):
    return metrics.confusion(_pred(spark, sf, 10), list(range(10)))


@query(f"""WITH {_PRED}, {_votes_sql(1, 'pred1')}, j AS (SELECT a.label, a.pred AS x, b.pred AS y FROM pred1 a JOIN pred10 b USING (query_id))
SELECT count(*) AS n, count(*) FILTER (x = y) AS agree, count(*) FILTER (x = label AND y = label) AS both_right, count(*) FILTER (x <> label AND y <> label) AS both_wrong,
count(*) FILTER (x = label AND y <> label) AS a_only, count(*) FILTER (x <> label AND y = label) AS b_only, count(*) FILTER (x <> y) AS disagree FROM j""")
def agreement(spark, sf):
    near = cut(_near(spark, sf))  # searched once for both
    return metrics.agreement(_pred(spark, sf, 1, near), _pred(spark, sf, 10, near))


_EXPERTS = f"{_PRED}, {_votes_sql(1, 'pred1')}, {_votes_sql(15, 'pred15')}, ex AS (SELECT 1 AS expert, query_id, label, pred FROM pred1 UNION ALL SELECT 10, query_id, label, pred FROM pred10 UNION ALL SELECT 15, query_id, label, pred FROM pred15)"


@query(f"WITH {_EXPERTS} SELECT a.expert AS a, b.expert AS b, round(avg(CASE WHEN a.expert = b.expert THEN CAST(a.pred = a.label AS INTEGER) ELSE CAST(a.pred = b.pred AS INTEGER) END), 9) AS agree FROM ex a JOIN ex b ON a.query_id = b.query_id AND a.expert <= b.expert GROUP BY 1, 2")
def pairwise_agreement(spark, sf):
    ex, near = None, cut(_near(spark, sf))
    for k in (1, 10, 15):
        part = _pred(spark, sf, k, near).select(F.lit(k).alias("expert"), "query_id", "label", "pred")
        ex = part if ex is None else ex.unionByName(part)
    return metrics.committee(ex)


@query(f"WITH {_EXPERTS}, a AS (SELECT * FROM v1 UNION ALL SELECT * FROM v10 UNION ALL SELECT * FROM v15), s AS (SELECT query_id, label, sum(p) AS p FROM a GROUP BY 1, 2) SELECT query_id, label AS pred FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, label) = 1")
def ensemble_vote(spark, sf):
    near = cut(_near(spark, sf))
    voted = similarity.votes(near, 1).unionByName(similarity.votes(near, 10)).unionByName(similarity.votes(near, 15))
    return metrics.ensemble(voted)


@query(f"""WITH {_PRED}, t AS (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 5 = 0), r AS (SELECT t.query_id, coalesce(p, 0) AS py FROM t LEFT JOIN v10 v ON v.query_id = t.query_id AND v.label = t.label),
b AS (SELECT r.query_id, greatest(py, 1e-12) AS py, (SELECT count(*) FROM v10 v WHERE v.query_id = r.query_id AND v.p > r.py) AS better FROM r)
SELECT count(*) AS n, round(exp(avg(-ln(py))), 6) AS ppl, round(avg(-ln(py)) / ln(2.0), 6) AS bits, round(avg(CAST(better < 1 AS INTEGER)), 9) AS top1, round(avg(CAST(better < 5 AS INTEGER)), 9) AS top5, round(avg(CAST(better < 10 AS INTEGER)), 9) AS top10 FROM b""")
def topk_accuracy(spark, sf):
    return metrics.topk(similarity.votes(_near(spark, sf), 10), _truth(spark, sf))


@query("WITH x AS (SELECT unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT CAST(i AS INTEGER) AS i, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS sd FROM x GROUP BY i")
def feature_stats(spark, sf):
    return metrics.feature_stats(table(spark, sf, "embeddings"), "embedding")


@query("""WITH c AS (SELECT label, unnest(range(0, 4)) AS layer, unnest(embedding[1:4]) AS x FROM embeddings WHERE label IN (1, 2, 3)), n AS (SELECT count(*) AS others FROM embeddings WHERE label NOT IN (1, 2, 3))
SELECT (SELECT count(*) FROM embeddings WHERE label IN (1, 2, 3)) AS n, others, CAST(layer AS INTEGER) AS layer, round(avg(CAST(x AS DOUBLE)), 9) AS mean, round(max(CAST(x AS DOUBLE)), 9) AS top FROM c, n GROUP BY layer, others""")
def layer_report(spark, sf):
    """Two runs of one row each side by side, with the first one's arrays zipped by layer."""
    e = table(spark, sf, "embeddings").withColumn("label", F.col("label").cast("int"))
    own = sampling.class_subset(e, "label", [1, 2, 3])
    at = [F.element_at("embedding", k + 1).cast("double") for k in range(4)]
    run = own.agg(F.count("*").alias("n"), F.array(*[F.round(F.avg(x), 9) for x in at]).alias("mean"), F.array(*[F.round(F.max(x), 9) for x in at]).alias("top"))
    other = e.where(~F.col("label").isin(1, 2, 3)).agg(F.count("*").alias("others"))
    return metrics.layers(run, other, ["mean", "top"])


@query("""WITH x AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM x)
SELECT vec_id, string_agg(i, ',' ORDER BY r) FILTER (r <= 4) AS top, round(CAST(max(x) FILTER (r = 1) AS DOUBLE) - CAST(max(x) FILTER (r = 5) AS DOUBLE), 6) AS margin, count(*) FILTER (r <= 4) AS winners FROM r GROUP BY vec_id""")
def sparse_codes(spark, sf):
    """The four largest components of each vector, the first one's margin over the fifth, and how many are on."""
    e = table(spark, sf, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    top = V.top_margins(F.col("v"), 4)
    on = F.aggregate(V.winners(F.col("v"), 4), F.lit(0), lambda s, x: s + x)
    return e.select("vec_id", F.array_join(F.transform(top, lambda t: t["idx"].cast("string")), ",").alias("top"), F.round(F.element_at(top, 1)["margin"], 6).alias("margin"), on.cast("long").alias("winners"))


@query("""WITH x AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings), g AS (SELECT *, row_number() OVER (PARTITION BY vec_id, i // 16 ORDER BY x DESC, i) AS rg FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM g WHERE rg <= 2)
SELECT vec_id, string_agg(i, ',' ORDER BY r) AS top FROM r WHERE r <= 4 GROUP BY vec_id""")
def grouped_top(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.array_join(F.transform(V.grouped_top(F.col("v"), 4, 2, 4), lambda i: i.cast("string")), ",").alias("top"))


@query("""WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), m AS (SELECT vec_id, max(x) AS m, count(*) AS k FROM x GROUP BY 1)
SELECT x.vec_id, round(m.m + ln(sum(exp(x.x - m.m))), 9) AS lse, round(m.m - ln(64.0) + ln(sum(exp(x.x - m.m))), 9) AS mixture FROM x JOIN m USING (vec_id) GROUP BY x.vec_id, m.m""")
def mixture_logp(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    even = F.transform("v", lambda _: F.lit(-1.0) * F.log(F.lit(64.0)))
    return e.select("vec_id", F.round(V.logsumexp(F.col("v")), 9).alias("lse"), F.round(ngrams.mixture_logp(even, F.col("v")), 9).alias("mixture"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 6) AS percent FROM events GROUP BY event_type")
def phase_shares(spark, sf):
    return metrics.shares(table(spark, sf, "events").select("event_type", F.lit(1).alias("n")), "event_type", "n")


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
s(user_id, i, ema) AS (SELECT user_id, i, value FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, 0.85 * s.ema + 0.15 * e.value FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT e.user_id, e.n, min(e.value) AS best, round(max(CASE WHEN s.i = e.n THEN s.ema END), 6) AS ema, round(avg(e.value) FILTER (e.i > e.n - 10), 6) AS last10, round(stddev_pop(e.value) FILTER (e.i > e.n - 30), 4) AS sd30
FROM e JOIN s ON s.user_id = e.user_id AND s.i = e.i GROUP BY e.user_id, e.n""")
def ema_series(spark, sf):
    return metrics.smoothed_series(table(spark, sf, "events"), "user_id", "event_id", "value")


@query("""SELECT CAST(i AS BIGINT) AS step, round(1e-5 + 0.5 * (3e-3 - 1e-5) * (1 + cos(pi() * least(1.0, i / 100.0))), 12) AS anneal, round(0.1 / (1 + 0.5 * i), 12) AS decay,
CAST(greatest(1, round_even(0.03 * i, 0)) AS BIGINT) AS warmup, printf('%d:%02d:%02d', i * 97 // 3600, i * 97 % 3600 // 60, i * 97 % 60) AS clock, 'run_' || i || '_a' AS name FROM (SELECT event_id AS i FROM events)""")
def schedules(spark, sf):
    """Rates and clocks of the steps that events stand for."""
    r = table(spark, sf, "events").select(F.col("event_id").alias("step"))
    s = F.col("step")
    return r.select("step", F.round(cosine_anneal(s, 100, 3e-3, 1e-5), 12).alias("anneal"), F.round(inverse_decay(s, 0.1, 0.5), 12).alias("decay"), warmup_steps(0.03, s).alias("warmup"), clock(s * 97).alias("clock"), safe_name(F.concat(F.lit("run/"), s.cast("string"), F.lit(":a"))).alias("name"))


# ---- replies and instruction rows: the tables have none, so these run over rows made from the conversations


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """A model's reply for each conversation: JSON in one of several wrappings, by conv_id."""
    m = _convs(spark, sf).withColumn("kind", F.pmod("conv_id", F.lit(4)))
    body = F.to_json(F.struct("messages"))
    text = F.when(F.col("kind") == 0, body).when(F.col("kind") == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("kind") == 2, F.concat(F.lit("Here it is: "), body, F.lit(" done"))).otherwise(F.substring(body, 1, 40))
    return m.select("conv_id", "messages", text.alias("reply"))


@query(f"""WITH {q.CLEAN}, r AS (SELECT conv_id, count(*) AS turns, bool_and(role IN ('system', 'user', 'assistant', 'tool')) AS known FROM conversations GROUP BY 1),
k AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'assistant') AS a FROM clean GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 4 <> 3 AND turns >= 2 AND known AND a > 0 THEN n END AS n_messages FROM r LEFT JOIN k USING (conv_id)""")
def parse_messages(spark, sf):
    got = _replies(spark, sf).select("conv_id", chat.parsed(F.col("reply")).alias("m"))
    return got.select("conv_id", F.when(F.col("m").isNotNull(), F.size("m")).cast("long").alias("n_messages"))


@query("""WITH a AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS n FROM conversations GROUP BY 1)
SELECT CASE conv_id % 3 WHEN 0 THEN 'tool_use' WHEN 1 THEN 'tool_broken' ELSE 'chat' END AS category, count(*) AS n, count(*) FILTER (conv_id % 3 = 2 OR (conv_id % 3 = 0 AND a.n > 0)) AS accepted FROM a GROUP BY 1""")
def tool_call_valid(spark, sf):
    """Rate of accepted conversations, with a call put into assistants' turns: sound for one kind, cut for another."""
    m = _convs(spark, sf).withColumn("kind", F.pmod("conv_id", F.lit(3)))
    call = F.when(F.col("kind") == 0, '<tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call>').when(F.col("kind") == 1, '<tool_call>{"name": "f", "arguments": {</tool_call>').otherwise("")
    said = F.transform("messages", lambda t: F.struct(t["role"].alias("role"), F.concat(t["content"], F.when(t["role"] == "assistant", call).otherwise("")).alias("content")))
    category = F.when(F.col("kind") == 0, "tool_use").when(F.col("kind") == 1, "tool_broken").otherwise("chat")
    got = m.select(category.alias("category"), said.alias("messages")).withColumn("ok", chat.accepted(F.col("category"), F.col("messages")))
    return got.groupBy("category").agg(F.count("*").alias("n"), F.count_if("ok").alias("accepted"))


@query(r"""WITH p AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS i, arg_min(text, turn) FILTER (role = 'assistant') AS r, arg_min(text, turn) FILTER (role = 'system') AS c FROM conversations GROUP BY 1),
s AS (SELECT conv_id, regexp_replace(coalesce(i, ''), '^\s+|\s+$', '', 'g') AS i, regexp_replace(coalesce(r, ''), '^\s+|\s+$', '', 'g') AS r, regexp_replace(coalesce(c, ''), '^\s+|\s+$', '', 'g') AS c FROM p)
SELECT conv_id, '<|user|>' || chr(10) || i || CASE WHEN c <> '' THEN chr(10) || chr(10) || c ELSE '' END || chr(10) || '<|assistant|>' || chr(10) || r || '<|end|>' AS text FROM s WHERE i <> '' AND r <> ''""")
def instruction_to_chat(spark, sf):
    t = table(spark, sf, "conversations")
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    rows = t.groupBy("conv_id").agg(first("user").alias("i"), first("assistant").alias("r"), first("system").alias("c"))
    got = rows.select("conv_id", chat.instruction_messages(F.col("i"), F.col("c"), F.col("r")).alias("m")).where(F.col("m").isNotNull())
    return got.select("conv_id", chat.chat_lite(F.col("m")).alias("text"))


@query("SELECT CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, count(DISTINCT conv_id) AS n, count(*) AS turns FROM conversations WHERE conv_id % 5 <> 0 GROUP BY 1")
def jsonl_scan(spark, sf):
    """Conversations as JSON lines, every fifth of them cut short, read back."""
    c = _convs(spark, sf).withColumn("category", F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd"))
    line = F.to_json(F.struct("messages", "category"))
    got = jsonl(c.select(F.when(F.col("conv_id") % 5 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")))
    return got.groupBy("category").agg(F.count("*").alias("n"), F.sum(F.size("messages")).alias("turns"))
