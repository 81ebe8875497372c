"""Scalar functions on text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space at both ends, words as runs of ASCII letters, and the characters that names keep.
STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
WORD = "[A-Za-z]+"
UNSAFE = "[^A-Za-z0-9_.-]"


def words(text: Column) -> Column:
    """Runs of ASCII letters, then in lower case: lowering first would turn a Kelvin sign into a letter."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), F.lower)


def strip(text: Column) -> Column:
    """Without white space at both ends, of all Unicode kinds and the four separators U+001C to U+001F."""
    return F.regexp_replace(text, STRIP, "")


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def md5_mod(text: Column, mod: int) -> Column:
    """The text's md5 as a 128-bit number, modulo `mod`, from four chunks of 32 bits."""
    digest = F.md5(text.cast("binary"))
    acc = F.lit(0).cast("long")
    for k in range(4):
        acc = (acc * F.lit((2**32) % mod) + F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")) % F.lit(mod)
    return acc


def safe_name(text: Column) -> Column:
    """A name with everything but letters, digits, ``_``, ``.`` and ``-`` as ``_``."""
    return F.regexp_replace(text, UNSAFE, "_")


def unit_draw(text: Column) -> Column:
    """A number in [0, 1) from 52 bits of the text's md5; the same in every engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def clock(seconds: Column) -> Column:
    """Seconds as h:mm:ss."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)
