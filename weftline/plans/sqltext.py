"""Common table expressions that the SQL statements of the catalog share."""

from __future__ import annotations

TOKENS = """
t0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS a FROM documents),
t1 AS (SELECT doc_id, unnest(a) AS w, unnest(range(0, len(a))) AS i FROM t0),
tok AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, doc_id, i, lower(w) AS token FROM t1)"""
SEPARATED = """
t0 AS (SELECT doc_id, list_append(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), '<SEP>') AS a FROM documents),
t1 AS (SELECT doc_id, unnest(a) AS w, unnest(range(0, len(a))) AS i FROM t0),
tok AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, doc_id, i, lower(w) AS token FROM t1)"""
FREQ = "freq AS MATERIALIZED (SELECT token AS word, count(*) AS freq FROM tok GROUP BY token)"
VOCAB = "vocab AS MATERIALIZED (SELECT row_number() OVER (ORDER BY freq DESC, word) AS id, word, freq FROM freq QUALIFY id <= 4095)"
IDS = "ids AS MATERIALIZED (SELECT pos, doc_id, coalesce(id, 0) AS token FROM tok LEFT JOIN vocab ON word = token)"
CUT = "cut AS (SELECT CAST(floor(count(*) * 9 / 10) AS BIGINT) AS c FROM tok)"


def parts(source: str) -> str:
    """train and test: the stream in `source` cut at nine tenths, with positions from 0 in each."""
    return f"""{CUT},
train AS MATERIALIZED (SELECT pos, token FROM {source}, cut WHERE pos < c),
test AS MATERIALIZED (SELECT pos - c AS pos, token FROM {source}, cut WHERE pos >= c)"""


CLEAN = r"""
msg AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g') AS content FROM conversations),
clean AS (SELECT * FROM msg WHERE role IN ('system', 'user', 'assistant', 'tool') AND content <> '')"""


def md5_mod(text: str, mod: int) -> str:
    acc = "0"
    for k in range(4):
        acc = f"((({acc}) * {(2**32) % mod} + CAST('0x' || substr(md5({text}), {8 * k + 1}, 8) AS BIGINT)) % {mod})"
    return acc


def unit_draw(text: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)"
