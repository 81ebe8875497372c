"""More queries of the catalog: gates and norms, biases, trends, retrieval fused into predictions, written and read files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import chat, metrics, sampling, similarity, tokens, vocab
from ..operators.lineage import scratch
from ..sources import readers, sinks
from ..sources.readers import table
from . import sqltext as q
from .catalog import _KEYWORDS, _convs, _docs, _keywords, _stream, _vocab, _words, query

_X = "x AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))


def _total(a):
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


@query(f"""WITH {_X}, k AS (SELECT vec_id, x AS cut FROM x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC) = 8)
SELECT vec_id, count(*) FILTER (x.x >= cut AND x.x > 0) AS awake, round(sum(CASE WHEN x.x >= cut THEN x.x ELSE 0 END), 6) AS kept, round(sum(greatest(x.x - 0.1, 0)), 6) AS relu FROM x JOIN k USING (vec_id) GROUP BY vec_id""")
def awake_gate(spark, sf):
    """The eight strongest components, how many of them are awake (above 0), and the sum above a threshold."""
    out = V.awake(F.col("v"), 8)
    return _vectors(spark, sf).select("vec_id", F.size(F.filter(out, lambda x: x > 0)).cast("long").alias("awake"), F.round(_total(out), 6).alias("kept"), F.round(_total(V.relu(F.col("v"), 0.1)), 6).alias("relu"))


@query(f"""WITH {_X}, m AS (SELECT vec_id, avg(x) AS mean, sqrt(avg(x * x)) + 1e-6 AS rms, stddev_pop(x) + 1e-4 AS sd, max(x) + ln(sum(exp(x))) - max(x) AS lse FROM x GROUP BY 1)
SELECT x.vec_id, round(max(x.x - lse), 6) AS log_softmax, round(max(x.x / rms), 6) AS divisive, round(max((x.x - mean) / sd), 6) AS contrast FROM x JOIN m USING (vec_id) GROUP BY x.vec_id""")
def vector_norms(spark, sf):
    """The largest component after each of three normalisations."""
    v = F.col("v")
    return _vectors(spark, sf).select("vec_id", *[F.round(F.array_max(f(v)), 6).alias(n) for n, f in (("log_softmax", V.log_softmax), ("divisive", V.divisive), ("contrast", V.contrast))])


@query(f"""WITH {_X}, s AS (SELECT a.i AS i, b.i AS j, avg(a.x * b.x) AS p, avg(a.x) AS a, avg(b.x) AS b FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(p - a * b, 9) AS cov FROM s""")
def feature_covariance(spark, sf):
    return metrics.covariance(table(spark, sf, "embeddings"), "embedding", 64)


@query(f"""WITH {_X}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM x), n AS (SELECT vec_id, max(x) FILTER (r = 5) AS fifth FROM r GROUP BY 1),
t AS (SELECT r.i, r.x - n.fifth AS margin FROM r JOIN n USING (vec_id) WHERE r.r <= 4)
SELECT count(*) AS codes, 64 - count(DISTINCT i) AS dead, round(count(DISTINCT i) / 64.0, 9) AS density, round(avg(margin), 9) AS mean_margin FROM t""")
def code_usage(spark, sf):
    """Units that no code of four uses, the share that is used, and the codes' mean margin."""
    top = _vectors(spark, sf).select(F.inline(V.top_margins(F.col("v"), 4)))
    used = F.count_distinct("idx")
    return top.agg(F.count("*").alias("codes"), (64 - used).alias("dead"), F.round(used / F.lit(64.0), 9).alias("density"), F.round(F.avg("margin"), 9).alias("mean_margin"))


@query(f"""WITH {q.TOKENS}, {q.FREQ}, {q.VOCAB}, v AS (SELECT count(*) AS v FROM vocab), c AS (SELECT freq, CAST(floor((id - 1) / ceil(v / 64.0)) AS BIGINT) AS class, CAST((id - 1) % ceil(v / 64.0) AS BIGINT) AS slot FROM vocab, v),
g AS (SELECT class, ln(sum(freq) + 0.5) AS class_bias FROM c GROUP BY 1), s AS (SELECT DISTINCT slot FROM c)
SELECT g.class, s.slot, round(coalesce(ln(freq + 0.5), -30), 9) AS bias, round(class_bias, 9) AS class_bias FROM g CROSS JOIN s LEFT JOIN c ON c.class = g.class AND c.slot = s.slot""")
def bias_init(spark, sf):
    got = vocab.biases(vocab.classes(_vocab(_words(spark, sf)), 64))
    return got.select("class", "slot", F.round("bias", 9).alias("bias"), F.round("class_bias", 9).alias("class_bias"))


@query("""SELECT user_id, event_id, value, count(*) OVER l AS n, round(avg(value) OVER l, 9) AS mean, min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best,
CASE WHEN lag(value) OVER w IS NULL THEN 'none' WHEN value < lag(value) OVER w - 1e-4 THEN 'down' WHEN value > lag(value) OVER w + 1e-4 THEN 'up' ELSE 'same' END AS trend
FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id), l AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def history_trend(spark, sf):
    return metrics.trends(table(spark, sf, "events"), "user_id", "event_id", "value")


@query(f"WITH {q.TOKENS}, {q.FREQ}, {q.VOCAB}, {q.IDS} SELECT count(*) AS n_tokens, max(token) AS max_id, count(*) FILTER (token = 0) AS unknown FROM ids")
def token_manifest(spark, sf):
    """The manifest's figures of a token stream, its largest id among them."""
    return vocab.mapped(_stream(spark, sf), _vocab(_words(spark, sf))).agg(F.count("*").alias("n_tokens"), F.max("id").alias("max_id"), F.count_if(F.col("id") == 0).alias("unknown"))


@query(f"""WITH {_KEYWORDS}, c AS (SELECT doc_id AS query_id, key, margin FROM kw WHERE doc_id % 20 = 0), o AS (SELECT query_id, sum(margin) AS self FROM c GROUP BY 1),
sc AS (SELECT query_id, p.doc_id, sum(margin) AS score FROM c JOIN post p USING (key) WHERE query_id <> p.doc_id GROUP BY 1, 2),
m AS (SELECT sc.query_id, d.lang AS label, score / self AS s FROM sc JOIN o USING (query_id) JOIN documents d ON d.doc_id = sc.doc_id),
v AS (SELECT query_id, label, sum(pow(s, 3)) AS w FROM m GROUP BY 1, 2), b AS (SELECT query_id, max(s) AS best, sum(pow(s, 3)) AS mass FROM m GROUP BY 1),
pr AS (SELECT lang AS label, count(*) / CAST((SELECT count(*) FROM documents) AS DOUBLE) AS p FROM documents GROUP BY 1)
SELECT b.query_id, pr.label, round((1 - 0.3 * pow(best, 3)) * pr.p + 0.3 * pow(best, 3) * coalesce(w, 0) / mass, 9) AS p FROM b CROSS JOIN pr LEFT JOIN v ON v.query_id = b.query_id AND v.label = pr.label""")
def fused_recall(spark, sf):
    """Shares of languages as a model, and the vote of documents with common keys mixed into it as far as the best match is good."""
    s = _words(spark, sf)
    d = _docs(spark, sf).select("doc_id", F.col("lang").alias("label"))
    got = similarity.recalled(_keywords(s.where(F.col("doc_id") % 20 == 0)).withColumnRenamed("doc_id", "query_id"), similarity.postings(s), d)
    n = F.broadcast(d.agg(F.count("*").alias("n")))
    prior = d.groupBy("label").agg(F.count("*").alias("c")).crossJoin(n).select("label", (F.col("c") / F.col("n")).alias("prior"))
    cases = got.groupBy("query_id").agg(F.max("best").alias("best")).crossJoin(F.broadcast(prior))  # one row for each language
    rows = cases.join(got.drop("best"), ["query_id", "label"], "left")
    p = similarity.fused(F.col("prior"), F.coalesce("p", F.lit(0.0)), 1 - similarity.adaptive_weight(F.col("best")))
    return rows.select("query_id", "label", F.round(p, 9).alias("p"))


@query(f"""WITH {q.CLEAN}, l AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY turn) AS t FROM clean GROUP BY conv_id)
SELECT 'text' AS kind, doc_id AS id, md5(text) AS digest FROM documents WHERE text <> '' UNION ALL SELECT 'chat_messages', conv_id, md5(t) FROM l""")
def serialized_sources(spark, sf):
    """Rows of two sources, each made text by the function that is registered for its kind."""
    out = []
    for kind, rows, key in (("text", _docs(spark, sf).select("doc_id", "text"), "doc_id"), ("chat_messages", _convs(spark, sf), "conv_id")):
        t = chat.SERIALIZERS[kind]({"field": "text"})
        out.append(rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), t.alias("t")).where("t IS NOT NULL"))
    return out[0].unionByName(out[1]).select("kind", "id", F.md5(F.col("t").cast("binary")).alias("digest"))


@query(f"""WITH t0 AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(0, 4)) AS w FROM t0 WHERE n > 32)
SELECT doc_id, CAST(w AS INTEGER) AS w, CAST(floor({q.unit_draw("'7:' || doc_id || ':' || w")} * (n - 32)) AS BIGINT) AS start FROM w""")
def random_windows(spark, sf):
    """Four seeded windows of 32 tokens in each document that is longer."""
    s = _stream(spark, sf).where("n > 32")
    return s.select("doc_id", F.posexplode(sampling.window_starts(4, F.col("doc_id"), F.lit(0).cast("long"), F.col("n") - 32, 7)).alias("w", "start"))


@query(f"SELECT doc_id, CAST(d AS INTEGER) AS draw, CAST(floor({q.unit_draw("doc_id || ':' || d")} * 64) AS BIGINT) AS slot FROM (SELECT doc_id, unnest(range(0, 8)) AS d FROM labels)")
def negative_slots(spark, sf):
    draws = F.explode(F.sequence(F.lit(0), F.lit(7)))
    return table(spark, sf, "labels").select("doc_id", draws.alias("draw")).withColumn("slot", sampling.negatives(F.col("doc_id"), F.col("draw"), 64))


@query(f"""WITH {_X}, y AS (SELECT vec_id, 0 AS copy, i, x FROM x UNION ALL SELECT vec_id, 1, 63 - i, x FROM x UNION ALL SELECT vec_id, 2, (i + 63) % 64, x FROM x
UNION ALL SELECT vec_id, 3, i, x + 0.05 * sin(i) FROM x UNION ALL SELECT vec_id, 4, i, x + 0.05 * (2 * {q.unit_draw("vec_id || ':' || i")} - 1) FROM x)
SELECT vec_id, copy, round(sum(x * (i + 1)), 6) AS moment FROM y GROUP BY 1, 2""")
def augmented_rows(spark, sf):
    got = sampling.augmented(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", "vec_id")
    return got.select("vec_id", "copy", F.round(_total(F.transform("embedding", lambda x, i: x * (i + 1))), 6).alias("moment"))


@query("""WITH k AS (SELECT vec_id, row_number() OVER (ORDER BY md5('3:' || vec_id), vec_id) AS r FROM embeddings) SELECT vec_id, CASE WHEN r <= 700 THEN 'train' ELSE 'test' END AS part FROM k""")
def frozen_split(spark, sf):
    return readers.frozen_split(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 700, 3)


@query(f"""WITH {q.SEPARATED} SELECT 'train' AS part, count(*) AS n, count(DISTINCT doc_id) AS docs, max(pos) AS last FROM tok UNION ALL SELECT 'eval', count(*), count(DISTINCT doc_id), max(pos) FROM tok WHERE pos < 5000""")
def token_tables(spark, sf):
    """A token stream written whole and cut to a budget, and read again."""
    s, whole, few = _stream(spark, sf, "<sep>"), scratch(spark, "tokens"), scratch(spark, "eval")
    sinks.tokens(s, whole)
    sinks.eval_tokens(spark.read.parquet(whole), few, 5000)  # what was written, so that the stream is made once
    read = spark.read.parquet(whole).withColumn("part", F.lit("train")).unionByName(spark.read.parquet(few).withColumn("part", F.lit("eval")))
    return read.groupBy("part").agg(F.sum("n").alias("n"), F.count_distinct("doc_id").alias("docs"), F.max(F.col("start") + F.col("n") - 1).alias("last"))


@query("SELECT CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, count(DISTINCT conv_id) AS n, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def jsonl_files(spark, sf):
    """Conversations appended as JSON lines in two runs, and read again by a pattern."""
    path = scratch(spark, "jsonl")
    rows = _convs(spark, sf).select("messages", F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd").alias("category"))
    for k in ("even", "odd"):
        sinks.jsonl(rows.where(F.col("category") == k), path)
    got = readers.jsonl_files(spark, [f"{path}/*.txt"])
    size = F.aggregate("messages", F.lit(0), lambda n, m: n + F.length(F.coalesce(m["content"], F.lit(""))))
    return got.groupBy("category").agg(F.count("*").alias("n"), F.sum(F.size("messages")).alias("turns"), F.sum(size).cast("long").alias("chars"))


@query("SELECT 'documents' AS source, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels")
def present_sources(spark, sf):
    """Of three sources the two that are there."""
    found = readers.sources(spark, {n: f"{sf}/{n}.parquet" for n in ("documents", "labels", "absent")})
    out = None
    for name, rows in sorted(found.items()):
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {q.TOKENS} SELECT doc_id, count(*) AS n FROM tok WHERE pos < 20000 GROUP BY doc_id")
def test_tokens(spark, sf):
    """The benchmark's split: documents with tokens until there are 20,000, the last one cut."""
    return readers.test_split(_stream(spark, sf), 20_000).select("doc_id", "n")


@query(f"""WITH {q.TOKENS}, {q.FREQ}, {q.VOCAB}, s AS (SELECT pos // 32 AS block, pos, token FROM tok WHERE pos < 3200)
SELECT block, md5(string_agg(coalesce(v.word, '<unk>'), ' ' ORDER BY pos)) AS digest FROM s LEFT JOIN vocab v ON v.word = s.token GROUP BY block""")
def detokenized_blocks(spark, sf):
    """Ids of a generation's blocks turned into words again."""
    s, v = _stream(spark, sf), _vocab(_words(spark, sf))
    ids = vocab.mapped(tokens.clamp(s, 3200), v).groupBy(F.floor(F.col("pos") / 32).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    return sinks.detokenized(ids, v).select("block", F.md5(F.col("text").cast("binary")).alias("digest"))
