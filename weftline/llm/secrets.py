"""Secret scans with corpus-wide ownership frequency, in DataFrame expressions only.

Candidates are the matches of a few patterns. The hash of each candidate's value is aggregated over the corpus, by
distinct owners and by distinct repositories of each owner: a value that ``OWNERS`` owners or ``REPOS`` repositories have
is a widely copied example, one that few owners have in few repositories is a live-looking credential. The three base patterns always give spans. A fourth,
wider pattern (``token``: 20 or more letters, digits, ``_`` or ``-`` with a capital, a small letter and a digit) would
take in many harmless strings; of its matches only the owner-specific ones outside base spans are added.

Offsets are code points, ends exclusive. Matches are leftmost and non-overlapping for each kind: the texts between
matches come from ``split`` and the matches from ``regexp_extract_all``, so their running lengths are the offsets.
Capital and small letters are equal in ASCII only, as the pattern names ASCII words.

Skew: each distinct text is scanned once; hashes are aggregated in three steps that combine before they shuffle; joins on
a text's or a value's hash stand between two plain exchanges, one of them of written rows, so that adaptive execution
splits the partition of a text or a secret with a third of all rows.

Defined cases: null texts count as empty; a null owner or repository counts as one of its own; repeated rows get equal
rows and count once; of kinds that begin at one place the order is that of KINDS; a text of any length is scanned whole;
an empty table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, whole_row

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
TOKEN = r"[A-Za-z0-9_-]{20,}"
LEAST = {"assign": 12, "access": 18, "hex": 16, "token": 20}
KINDS = ("assign", "access", "hex", "token")
#: A text without these can't hold a match that is long enough; they only save work.
MAY = {
    "assign": ASSIGN.replace("=-]+)", "=-]{12,})"),
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "token": TOKEN,
}
OWNERS, REPOS = 3, 20  # a value that so many owners have, or more, or so many repositories, is a copied example
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def may_hold(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (t.contains("AKIA") & t.rlike(MAY["access"])) | t.rlike(MAY["hex"]) | t.rlike(MAY["token"]) | t.rlike(MAY["assign"])


def _kind(text: Column, kind: str) -> Column:
    """All matches of one kind: array of (kind, ahead: length of the text before, since the last match; size; value)."""
    whole = {"assign": ASSIGN, "access": ACCESS, "hex": MAY["hex"], "token": TOKEN}[kind]
    value = F.regexp_extract_all(text, F.lit(whole), F.lit(2 if kind == "assign" else 0))
    zipped = F.arrays_zip(
        F.split(text, whole, -1).alias("ahead"),
        F.regexp_extract_all(text, F.lit(whole), F.lit(0)).alias("hit"),
        value.alias("value"),
    )
    made = F.transform(
        F.filter(zipped, lambda z: z["hit"].isNotNull()),
        lambda z: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.length(z["ahead"]).alias("ahead"), F.length(z["hit"]).alias("size"), z["value"].alias("value")),
    )
    none = F.array().cast("array<struct<kind:int,ahead:int,size:int,value:string>>")
    return F.when(text.rlike(MAY[kind]), made).otherwise(none)


def spans(texts: DataFrame, text_col: str = "text", key: str = "digest") -> DataFrame:
    """key, kind (its place in KINDS), start, end, value of all candidates of distinct texts; too short ones are gone."""
    t = F.col(text_col)
    before = Window.partitionBy(key, "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = None
    # one generator over all kinds: each row's place in its kind follows from its place in the array
    all_kinds = F.concat(*[_kind(t, k) for k in KINDS])
    rows = texts.select(key, F.posexplode(all_kinds).alias("nth", "m")).select(key, "nth", "m.*")
    end = F.sum(F.col("ahead") + F.col("size")).over(before)
    rows = rows.select(key, "kind", "value", end.alias("end"), (end - F.col("size")).alias("start"))
    least = F.element_at(F.array(*[F.lit(LEAST[k]) for k in KINDS]), F.col("kind") + 1)
    rich = F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[0-9]")
    rows = rows.where((F.length("value") >= least) & ((F.col("kind") != KINDS.index("token")) | rich))
    # of the wider kind, none that overlaps a base span
    base = F.col("kind") < KINDS.index("token")
    order = Window.partitionBy(key).orderBy("start", "kind")
    last = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(last, F.lit(-1)) <= F.col("start")) & (F.coalesce(following, F.lit(2**31)) >= F.col("end"))
    return rows.withColumn("__keep", base | free).where("__keep").drop("__keep").withColumn("hash", F.sha2("value", 256))


def ownership(found: DataFrame, owners: int = OWNERS, repos: int = REPOS) -> DataFrame:
    """hash, n_owners, n_repos, live: from rows of (hash, owner, repo); each step combines before it shuffles.

    Repositories are counted by owner: two owners' repositories of one name are two.
    """
    once = found.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("__one"))
    by_owner = once.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    got = by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))
    return got.withColumn("live", (F.col("n_owners") < owners) & (F.col("n_repos") < repos))


def found_in(cand: DataFrame, owners: int = OWNERS, repos: int = REPOS) -> DataFrame:
    """digest, kind, start, end, value, n_owners, n_repos, live of all spans: base ones, and wider ones that are owner-specific.

    cand: digest, text, owner, repo of the documents that may hold a match.
    """
    texts = cand.groupBy("digest").agg(F.first("text").alias("text"))
    own = checkpointed(spans(texts))
    held = checkpointed(own.select("digest", "hash").distinct())
    pairs = cand.select("digest", "owner", "repo").join(held, "digest").select("hash", "owner", "repo")
    stats = checkpointed(ownership(pairs, owners, repos))
    return own.join(stats, "hash", "left").where((F.col("kind") < KINDS.index("token")) | F.col("live"))


def described(found: DataFrame) -> DataFrame:
    """One row for each digest: counts and the spans as text."""
    got = found.groupBy("digest").agg(
        *[F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(~F.col("live"), 1)).alias("n_example"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repos").alias("most_repos"),
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("__all"),
    )
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"], s["end"])
    base = F.transform(F.filter("__all", lambda s: s["kind"] < KINDS.index("token")), name)
    return got.withColumns({"base": F.array_join(base, ","), "spans": F.array_join(F.transform("__all", name), ",")}).drop("__all")


def candidates(docs: DataFrame, text_col: str, owner_col: str, repo_col: str, id_col: str | None = None) -> DataFrame:
    """The documents that may hold a match: digest, text, owner, repo (and id)."""
    cols = {"text": text_col, "owner": owner_col, "repo": repo_col} | ({"id": id_col} if id_col else {})
    return docs.where(may_hold(F.col(text_col))).select(F.sha2(F.col(text_col), 256).alias("digest"), *[F.col(c).alias(n) for n, c in cols.items()])


def scanned(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", id_col: str = "doc_id", owners: int = OWNERS, repos: int = REPOS) -> DataFrame:
    """One row for each row of docs: the id, counts of each kind, n_live, n_example, most_owners and most_repos (the largest
    numbers of owners and repositories of a value in the text; 0 without a span), base_sha256 and spans."""
    cand = checkpointed(candidates(docs, text_col, owner_col, repo_col, id_col))
    got = checkpointed(described(found_in(cand, owners, repos)))
    cols = [*[f"n_{k}" for k in KINDS], "n_live", "n_example", "most_owners", "most_repos"]
    none = docs.where(~may_hold(F.col(text_col))).select(F.col(id_col).alias("id"))
    zero = {c: F.lit(0).cast("long") for c in cols} | {"base": F.lit(""), "spans": F.lit("")}
    with_any = cand.select("id", "digest").join(got, "digest", "left")
    rows = with_any.select("id", *[F.coalesce(F.col(c), z).alias(c) for c, z in zero.items()]).unionByName(none.withColumns(zero))
    return rows.select(F.col("id").alias(id_col), *cols, F.sha2("base", 256).alias("base_sha256"), "spans")


def op2(docs: DataFrame) -> DataFrame:
    got = scanned(docs)
    return got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token", "n_live", "n_example", "most_owners", "most_repos")


def cut_out(text: Column, parts: Column, mark: str) -> Column:
    """The text with each of the parts, an array of (a, b) in order, replaced by the mark; parts that overlap get one."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, p: Column) -> Column:
        ahead = F.concat(s["out"], text.substr(s["at"] + 1, p["a"] - s["at"]), F.lit(mark))
        return F.struct(F.greatest(s["at"], p["b"]).alias("at"), F.when(p["a"] >= s["at"], ahead).otherwise(s["out"]).alias("out"))

    return F.aggregate(parts, begin, step, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))


def redacted(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", mark: str = "[secret]", owners: int = OWNERS, repos: int = REPOS) -> DataFrame:
    """The documents, with all their columns, with live-looking values replaced in `text` and `n_chars` set anew.

    Values are cut out at their places: nothing else of the text changes, copied examples stay, and of a match only the
    value goes, not the word before it. Defined cases: as above; rows whose text holds no live value come back as they are,
    null texts too; columns of any names stay.
    """
    cand = checkpointed(candidates(docs, "text", owner_col, repo_col))
    part = F.struct((F.col("end") - F.length("value")).cast("int").alias("a"), F.col("end").cast("int").alias("b"))
    live = checkpointed(found_in(cand, owners, repos).where("live").groupBy("digest").agg(F.array_sort(F.collect_set(part)).alias("parts")))
    rows = docs.select(whole_row(docs).alias("row"))
    held = rows.where(may_hold(F.col("row.text"))).withColumn("key", F.sha2("row.text", 256)).join(live, F.col("key") == F.col("digest"), "left")
    text = F.when(F.col("parts").isNotNull(), cut_out(F.col("row.text"), F.col("parts"), mark)).otherwise(F.col("row.text"))
    held = held.select("row", "parts", text.alias("new"))

    def column(c: str) -> Column:
        own = F.col("row").getField(c)
        if c == "text":
            return F.col("new").alias(c)
        if c == "n_chars":
            return F.when(F.col("parts").isNotNull(), F.length("new")).otherwise(own).cast(docs.schema[c].dataType).alias(c)
        return own.alias(c)

    return docs.where(~may_hold(F.col("text"))).unionByName(held.select(*[column(c) for c in docs.columns]))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
p AS (SELECT 0 AS kind, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS pat, 12 AS least
  UNION ALL SELECT 1, 'AKIA[A-Z0-9]+', 18 UNION ALL SELECT 2, '[0-9a-f]{16,}', 16 UNION ALL SELECT 3, '[A-Za-z0-9_-]{20,}', 20),
z AS (SELECT doc_id, text, source, 0 AS kind, regexp_extract_all(text, (SELECT pat FROM p WHERE kind = 0)) AS hits, regexp_extract_all(text, (SELECT pat FROM p WHERE kind = 0), 2) AS vals,
    regexp_split_to_array(text, (SELECT pat FROM p WHERE kind = 0)) AS gaps FROM d
  UNION ALL SELECT doc_id, text, source, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_split_to_array(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, text, source, 2, regexp_extract_all(text, '[0-9a-f]{16,}'), regexp_extract_all(text, '[0-9a-f]{16,}'), regexp_split_to_array(text, '[0-9a-f]{16,}') FROM d
  UNION ALL SELECT doc_id, text, source, 3, regexp_extract_all(text, '[A-Za-z0-9_-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9_-]{20,}'), regexp_split_to_array(text, '[A-Za-z0-9_-]{20,}') FROM d),
m AS (SELECT doc_id, source, kind, unnest(range(1, len(hits) + 1)) AS nth, hits, vals, gaps FROM z WHERE len(hits) > 0),
s AS (SELECT doc_id, source, kind, nth, vals[nth] AS val, length(hits[nth]) AS size,
    sum(length(gaps[nth]) + length(hits[nth])) OVER (PARTITION BY doc_id, kind ORDER BY nth) AS stop FROM m),
k AS (SELECT doc_id, source, kind, val, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM s
  WHERE length(val) >= CASE kind WHEN 0 THEN 12 WHEN 1 THEN 18 WHEN 2 THEN 16 ELSE 20 END
    AND (kind < 3 OR (regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[0-9]')))),
u AS (SELECT * FROM k WHERE kind < 3 UNION ALL
  SELECT a.* FROM k a WHERE a.kind = 3 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.kind < 3 AND b.doc_id = a.doc_id AND b.start < a.stop AND b.stop > a.start)),
o AS (SELECT val, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT struct_pack(a := coalesce(source, chr(0)), b := doc_id)) AS repos FROM u GROUP BY val),
f AS (SELECT u.*, owners, repos, owners < 3 AND repos < 20 AS live FROM u JOIN o USING (val) WHERE kind < 3 OR (owners < 3 AND repos < 20)),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_token,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example, max(owners) AS most_owners, max(repos) AS most_repos,
    string_agg(CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' ELSE 'hex' END || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
    string_agg(CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'token' END || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_token, 0) AS n_token, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
  coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM d LEFT JOIN g USING (doc_id)
"""
