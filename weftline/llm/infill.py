"""Fill-in-middle transformation by one numpy kernel for a whole batch of texts.

All texts of a batch lie end to end in Arrow's UTF-8 buffer. A lookup gives each byte's class, a table over the classes of
adjacent bytes says where a unit starts, and a document's first byte always starts one. The running count of starts, less
the count at the document's beginning, numbers each document's units; ``searchsorted`` on it finds the byte of every cut of
every row together. Pieces are slices of the same buffer, put in order by Arrow; no text is looked at by itself.

``h1`` to ``h4`` are the first four 8-digit groups of the hex sha256 of ``seed:id``. The prefix ends after the smaller of
h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. A text is left plain if it is empty, holds a mark, or
h3 % 100 is not under ``rate``; else it becomes ``spm`` (suffix, prefix, middle) if h4 % 100 is under ``spm``, else ``psm``
(prefix, suffix, middle). ``restored`` gives the text back from output and form alone: no text with a mark in it is taken
apart, and marks have no beginning that is also their end, so the first mark after a piece is the one put there.

Units are code points (``chars``) or words with the blanks behind them (``words``; blanks are the bytes 9 to 13 and 32).

Defined cases: a null text is an empty one; a null id is hashed as an empty one; rows that repeat give rows that repeat; texts
of any length are cut whole, a long one in a batch of its own; an empty table gives no rows; other columns, whatever their
names, play no part and come back only if they are asked for (``keep``), but for those named as a computed one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_utf8, sub_batches, unused

MARKS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
RATE, SPM = 90, 20  # of 100 texts that are transformed, and of 100 of those with the suffix first
FORMS = ("plain", "psm", "spm")

INSIDE, BLANK, OTHER = 0, 1, 2  # byte classes: a code point's further bytes, blanks, the rest
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x80:0xC0] = INSIDE
CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
_STARTS = np.zeros((2, 3, 3), bool)  # by class of the byte before and of the byte itself
_STARTS[0, :, [BLANK, OTHER]] = True
_STARTS[1, BLANK, OTHER] = True
UNITS = {"chars": _STARTS[0], "words": _STARTS[1]}


def numbered(data: np.ndarray, off: np.ndarray, units: str) -> np.ndarray:
    """How many units have started up to and with each byte, over the whole batch."""
    cls = CLASS[data]
    start = np.empty(len(data), bool)
    start[1:] = UNITS[units][cls[:-1], cls[1:]]
    start[off[:-1][off[:-1] < off[1:]]] = True
    return np.cumsum(start, dtype=np.int32)


def before(count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Units that started in front of these bytes."""
    return np.where(at > 0, count[np.maximum(at, 1) - 1], 0).astype(np.int64) if len(count) else np.zeros(len(at), np.int64)


def found(data: np.ndarray, off: np.ndarray, mark: bytes) -> np.ndarray:
    """Places of a mark in the buffer, none across two texts."""
    if len(data) < len(mark):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[: len(data) - len(mark) + 1] == mark[0])
    for k in range(1, len(mark)):
        at = at[data[at + k] == mark[k]]
    return at[at + len(mark) <= off[np.searchsorted(off, at, "right")]]


def sliced(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The pieces between consecutive places of the buffer, without a copy."""
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(data))


def joined(*parts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*parts, pa.scalar("", pa.large_string())).cast(pa.string())


def transformed(texts: pa.Array, h: list[np.ndarray], marks: tuple[str, str, str] = MARKS, rate: int = RATE, spm: int = SPM, units: str = "chars") -> list[pa.Array]:
    """n (units), form, prefix_chars, middle_chars and output of each text; h: the four draws of each."""
    data, off = flat_utf8(texts)
    rows = len(off) - 1
    count = numbered(data, off, units)
    base = before(count, off[:-1])
    n = before(count, off[1:]) - base
    draws = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), 0)
    cuts = np.searchsorted(count, base + draws + 1) if len(data) else np.zeros((2, rows), np.int64)
    cuts = np.clip(cuts, off[:-1], off[1:])
    marked = np.zeros(rows, bool)
    for m in marks:
        marked[np.searchsorted(off, found(data, off, m.encode()), "right") - 1] = True
    plain = (n == 0) | marked | (h[2] % 100 >= rate)
    form = np.where(plain, 0, np.where(h[3] % 100 < spm, 2, 1))

    pieces = sliced(data, np.r_[np.stack([off[:-1], cuts[0], cuts[1]], 1).ravel(), off[-1]])
    order = np.array([[0, 1, 2], [0, 2, 1], [2, 0, 1]])[form]  # of plain texts, prefix, middle and suffix come as they were
    before_piece = np.where(plain[:, None], 3, order)
    names = pa.array([marks[0], marks[2], marks[1], ""], pa.large_string())  # by piece
    parts = []
    for k in range(3):
        parts += [names.take(pa.array(before_piece[:, k])), pieces.take(pa.array(3 * np.arange(rows) + order[:, k]))]
    chars = count if units == "chars" else numbered(data, off, "chars")
    lens = np.diff(np.stack([before(chars, off[:-1]), before(chars, cuts[0]), before(chars, cuts[1])]), axis=0)
    return [pa.array(n), pa.array(FORMS).take(pa.array(form)), pa.array(lens[0], mask=plain), pa.array(lens[1], mask=plain), joined(*parts)]


def back(outputs: pa.Array, forms: pa.Array, marks: tuple[str, str, str] = MARKS) -> pa.Array:
    """The text of each output, from its marks' places."""
    data, off = flat_utf8(outputs)
    form = pc.index_in(forms, pa.array(FORMS)).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = form > 0
    size = np.array([len(m.encode()) for m in marks])
    places = [np.r_[found(data, off, m.encode()), len(data)] for m in marks]
    starts = []  # of mark, piece, mark, piece, mark, piece
    for k in range(3):
        mark = np.array([[0, 1, 2], [0, 1, 2], [1, 0, 2]])[form, k]  # the one that comes first, second, third
        at = off[:-1] if k == 0 else off[1:].copy()  # a plain text is one piece, behind a mark without bytes
        for m in range(3) if k else ():
            mine = cut & (mark == m)
            at[mine] = places[m][np.searchsorted(places[m], starts[-1][mine])]
        if (at > off[1:] - np.where(cut, size[mark], 0)).any():
            raise ValueError("an output lacks a mark of its form")
        starts += [at, at + np.where(cut, size[mark], 0)]
    pieces = sliced(data, np.r_[np.stack(starts, 1).ravel(), off[-1]])
    text = np.array([[1, 3, 5], [1, 5, 3], [3, 5, 1]])[form]
    return joined(*[pieces.take(pa.array(6 * np.arange(len(form)) + text[:, k])) for k in range(3)])


def checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    for m in marks:
        if not m or any(m.startswith(m[k:]) for k in range(1, len(m))):
            raise ValueError(f"the mark {m!r} is empty or begins as it ends")
    if len(set(marks)) < 3:
        raise ValueError("the three marks must differ")
    return marks


def draws(id_col: Column, seed: int) -> list[Column]:
    """h1 to h4 of a row."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def batched(df: DataFrame, text_col: str, rest: list[str], fields: list[T.StructField], keep: list[str], fn) -> DataFrame:
    """`keep` beside what ``fn(texts, columns of rest)`` gives, for slices of some bytes of text, without a shuffle."""
    src = df.select(*[F.col(f"`{c}`") for c in (*keep, *rest)], F.col(f"`{text_col}`"))
    schema = T.StructType([*[src.schema[c] for c in keep], *fields])
    at, names = len(keep) + len(rest), schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *fn(part.column(at), part.columns[len(keep) : at])], names=names)
                pa.default_memory_pool().release_unused()

    return src.mapInArrow(run, schema)


def infilled(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    marks: tuple[str, str, str] = MARKS,
    rate: int = RATE,
    spm: int = SPM,
    units: str = "chars",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The id and `keep`, n (units), form, prefix_chars and middle_chars (code points; null if plain) and output."""
    checked(marks)
    fields = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    new = {f.name for f in fields}
    keep = [c for c in dict.fromkeys((id_col, *keep)) if c.lower() not in new]
    names = [unused(f"__h{k}", keep) for k in range(4)]
    text = unused("__text", keep, names)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], *[d.alias(n) for n, d in zip(names, draws(F.col(f"`{id_col}`"), seed), strict=True)], F.col(f"`{text_col}`").cast("string").alias(text))
    return batched(src, text, names, fields, keep, lambda texts, h: transformed(texts, [x.to_numpy(zero_copy_only=False) for x in h], marks, rate, spm, units))


def restored(rows: DataFrame, output_col: str = "output", form_col: str = "form", marks: tuple[str, str, str] = MARKS, name: str = "restored") -> DataFrame:
    """The rows with the text that each output was made of."""
    keep = [c for c in rows.columns if c != name]
    form = unused("__form", keep)
    src = rows.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{form_col}`").alias(form), F.col(f"`{output_col}`").alias(unused("__output", keep)))
    return batched(src, src.columns[-1], [form], [T.StructField(name, T.StringType())], keep, lambda outputs, f: [back(outputs, f[0], marks)])


def op11(docs: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return restored(infilled(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
