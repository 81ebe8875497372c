"""BPE encoding and decoding with content-defined chunk reuse.

A text's UTF-8 bytes are cut where a rolling hash of the last 16 bytes meets a mask, so that a passage is cut alike
wherever it occurs. A chunk is encoded once and then taken from a bounded cache of the worker, by a 128-bit digest of its
bytes; the cache holds the chunks of 12 to 25 MB of text. A cut may fall inside a word; so a chunk holds the
ids of what lies between its first and its last blank, and the two open ends as text. Each join is repaired by encoding
the end before it together with the beginning after it, over further chunks until a blank closes the piece on either
side. Blanks are where the tokenizer's own split can't be crossed (`blanks_split` checks the file for that), so after the
repair the ids agree exactly with those of the whole text.

Pieces between blanks are encoded by the tokenizers library, each distinct one once for as long as it stays in a
second bounded cache. A tokenizer file that doesn't split at blanks has each whole text encoded by the library.

Decoding starts from the ids alone: exactly the library's decoder, or for a file without a decoder the ids' tokens with
one blank between them (byte for byte what its decode() gives then).

Defined cases: null and empty texts have no ids and decode to an empty text; a text of any length is handled whole, in
memory of its size times a constant; repeated rows get equal rows; an empty table gives no rows; a kept column that is
named as a result gives way to it.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_utf8, map_texts

WINDOW, MEAN = 16, 512  # bytes that the rolling hash sees; mean bytes between two cuts
CHUNKS, PIECES = 25_000, 100_000  # entries of the two caches, each kept in two generations
AT_ONCE = 2 << 20  # bytes of text


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Cache:
    """A dictionary of bounded size: when the young generation is full, it becomes the old one, which is dropped."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        self.young[key] = value
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}


def cuts(data: np.ndarray, off: np.ndarray, mean: int = MEAN) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of all texts end to end, and how many each text has. No chunk is empty; a character is whole.

    The hash of a place is a polynomial in the 16 bytes before it, so equal passages have equal cuts but for their
    first 16 bytes, whatever stands around them.
    """
    n = len(data)
    h = np.zeros(n + 1, np.uint32)
    if n >= WINDOW:
        x = data.astype(np.uint32) * np.uint32(0x9E3779B1) ^ np.uint32(0x85EBCA6B)
        have, span = x, 1  # hash of `span` bytes from each place, doubled until it covers the window
        mul = 0x01000193
        while span < WINDOW:
            have = have[:-span] * np.uint32(mul) + have[span:]
            mul, span = mul * mul & 0xFFFFFFFF, span * 2
        h[WINDOW:] = have[: n - WINDOW + 1]
    cut = (h >> np.uint32(8)) % np.uint32(mean) == np.uint32(mean - 1)
    cut[:-1] &= (data & 0xC0) != 0x80
    cut[off] = False
    at = np.flatnonzero(cut)
    filled = off[1:][np.diff(off) > 0]
    ends = np.sort(np.concatenate([at, filled]))
    return ends, np.searchsorted(ends, off[1:], "right") - np.searchsorted(ends, off[:-1], "right")


def blanks_split(spec: dict) -> bool:
    """Whether the file's own steps never let a token reach across a blank or a line end, and leave the rest alone.

    True for: normalizers that are NFC, lower case or blanks to one blank; a first split that drops blanks; a model
    without whole-text state; added tokens without blanks and without stripping; nothing behind the model.
    """
    norm = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    parts = norm.get("normalizers", [norm])
    easy = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " " for x in parts)
    pre = spec.get("pre_tokenizer") or {}
    split = (pre.get("pretokenizers") or [pre])[0]
    drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and split["pattern"].get("Regex", "").endswith("|[^\\s\\p{L}\\p{N}]+")
    later = all(x["type"] == "ByteLevel" and not x["add_prefix_space"] for x in (pre.get("pretokenizers") or [pre])[1:])
    added = all(not set(x["content"]) & {" ", "\n"} and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in spec.get("added_tokens", []))
    return bool(easy and drops and later and added and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not spec.get("post_processor"))


def lowers_letters(spec: dict) -> bool:
    """Whether the file's own steps put letters in lower case and part a run of letters from a dot or comma behind it.

    Only then may `core_of` and plain stretches do the same beforehand, which leaves fewer different pieces.
    """
    return '{"type": "Lowercase"}' in json.dumps(spec["normalizer"]) and "|[\\\\p{L}]+|" in json.dumps(spec["pre_tokenizer"])


def core_of(piece: str) -> tuple[str, str]:
    """A piece that encodes to the same ids, of fewer different ones, and a mark to encode behind it (or '').

    A dot or comma after a letter is a piece of its own in the split, and the files lower case before it. Both hold
    for any letter; here only letters up to U+00FF are touched, where all libraries agree on what is a letter.
    """
    end = piece[-1:]
    core = piece[:-1] if end in (".", ",") else piece
    if core.isalpha() and max(core) <= "\xff":
        return core.lower(), end if core is not piece else ""
    return piece, ""


class Encoder:
    """Encodes and decodes texts; lives in a worker, with its caches."""

    def __init__(self, path: str, mean: int = MEAN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.splits, self.plain, self.mean = blanks_split(spec), spec.get("decoder") is None, mean
        self.tokens = [self.lib.id_to_token(i) or "" for i in range(self.lib.get_vocab_size(with_added_tokens=True))] if self.plain else []
        self.words = pa.array(self.tokens, pa.string()) if self.plain else None
        self.lowers = self.splits and lowers_letters(spec)
        special = [x for x in spec.get("added_tokens", []) if x["special"] and x["content"][:2] not in x["content"][1:]]
        self.between = (special[0]["content"], special[0]["id"]) if special else None
        self.pieces, self.chunks = Cache(PIECES), Cache(CHUNKS)
        self.seen = self.encoded = 0  # chunks so far, and those that the cache didn't have

    def fill(self, missing: list[str]) -> dict[str, bytes]:
        """Ids (as int32 bytes) of pieces, encoded by the library.

        Many pieces go into one call, with a special token between them: the library cuts a text at special tokens
        before anything else, and one can't begin in a piece and end in the separator. Pieces that hold its first two
        characters go alone.
        """
        out = {}
        alone = [x for x in missing if self.between is None or self.between[0][:2] in x]
        for piece, e in zip(alone, self.lib.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            out[piece] = np.array(e.ids, np.int32).tobytes()
        if len(alone) == len(missing):
            return out
        mark, mark_id = self.between
        rest = [x for x in missing if x not in out]
        for lo in range(0, len(rest), 1000):
            part = rest[lo : lo + 1000]
            ids = np.array(self.lib.encode_batch_fast([mark.join(part)], add_special_tokens=False)[0].ids, np.int32)
            cut = np.flatnonzero(ids == mark_id)
            raw = ids.tobytes()
            for piece, a, b in zip(part, [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)], strict=True):
                out[piece] = raw[4 * a : 4 * b]
        return out

    def open_chunk(self, chunk: str) -> tuple[str, str | None, str]:
        """Text before the first blank, between the first and the last, and after the last; without a blank: all, None, ''."""
        a = chunk.find(" ")
        if a < 0:
            return chunk, None, ""
        b = chunk.rfind(" ")
        return chunk[:a], chunk[a:b], chunk[b + 1 :]

    def learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, from the cache or the library."""
        got = list(map(self.pieces.young.get, pieces))
        if None not in got:
            return got
        missing = {pieces[i] for i, x in enumerate(got) if x is None}
        known, cores = {}, {}
        for piece in missing:
            have = self.pieces.old.get(piece)
            if have is None:
                cores[piece] = core_of(piece) if self.lowers else (piece, "")
            else:
                known[piece] = have
        young, old = self.pieces.young, self.pieces.old
        parts = {y for core in cores.values() for y in core} - {""}
        found = {y: x for y in parts if (x := young.get(y, old.get(y))) is not None}
        new = sorted(parts - found.keys())
        found |= self.fill(new) | {"": b""}
        for piece, (core, end) in cores.items():
            known[piece] = found[core] + found[end]
        for piece, x in known.items():
            self.pieces.put(piece, x)
        for core in new:
            self.pieces.put(core, found[core])
        return [known[pieces[i]] if x is None else x for i, x in enumerate(got)]

    def inside(self, inners: list[str], plain: bool) -> list[bytes]:
        """Ids of each of these stretches between blanks.

        Only the distinct pieces of them all are looked up; the rest is gathering by their numbers. Plain stretches have
        no letter above U+00FF and no special token: they are put in lower case, and parted between letter and dot or
        comma, as the file's own steps would do.
        """
        arr = pa.array(inners, pa.large_string())
        if plain:
            arr = pc.replace_substring_regex(pc.utf8_lower(arr), "([a-zß-öø-ÿ])([.,])", r"\1 \2")
        parts = pc.split_pattern(arr, " ")
        off = parts.offsets.to_numpy()
        off = off - off[0]
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = self.learn(coded.dictionary.to_pylist())
        size = np.fromiter((len(x) // 4 for x in known), np.int64, len(known))
        start, count = np.r_[0, np.cumsum(size)], size[codes]
        ends = np.r_[0, np.cumsum(count)]
        ids = np.frombuffer(b"".join(known), np.int32)
        raw = ids[np.arange(ends[-1]) + np.repeat(start[codes] - ends[:-1], count)].tobytes()
        at = (4 * ends[off]).tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Ids (int32 bytes) of each text, given as UTF-8 end to end."""
        raw = data.tobytes()
        if not (self.splits and self.plain):
            got = self.lib.encode_batch([raw[a:b].decode() for a, b in zip(off[:-1], off[1:], strict=True)], add_special_tokens=False)
            return [np.array(e.ids, np.int32).tobytes() for e in got]
        ends, count = cuts(data, off, self.mean)
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        odd = np.r_[0, np.cumsum((data > 0xC3) | (data == 0x3C))]  # beyond U+00FF, or the beginning of a special token
        plain = ((odd[ends] == odd[starts]) & self.lowers).tolist()
        # each chunk that is new in this worker is encoded once
        keys, have, new = [], {}, {}
        for a, b, easy in zip(starts.tolist(), ends.tolist(), plain, strict=True):
            c = raw[a:b]
            k = hashlib.blake2b(c, digest_size=16).digest()
            keys.append(k)
            if k not in have and k not in new:
                got = self.chunks.get(k)
                if got is None:
                    new[k] = (*self.open_chunk(c.decode().replace("\n", " ")), easy)
                else:
                    have[k] = got
        self.seen += len(keys)
        self.encoded += len(new)
        for easy in (True, False):
            own = [(k, x) for k, x in new.items() if x[3] == easy and x[1] is not None]
            for lo in range(0, len(own), 20_000):  # far below what 32-bit offsets hold
                part = own[lo : lo + 20_000]
                for (k, x), got in zip(part, self.inside([x[1] for _, x in part], easy), strict=True):
                    have[k] = x[0], got, x[2]
        have |= {k: (x[0], None, x[2]) for k, x in new.items() if x[1] is None}
        for k in new:
            self.chunks.put(k, have[k])
        # the joins: pieces that are open where chunks meet, closed by the next blank
        plans: list[list] = []
        joins: list[str] = []
        at = 0
        for n in count.tolist():
            plan, piece = [], []
            for k in keys[at : at + n]:
                head, inner, tail = have[k]
                piece.append(head)
                if inner is not None:
                    plan += ["".join(piece), inner]
                    piece = [tail]
            plan.append("".join(piece))
            joins += [x for x in plan if isinstance(x, str)]
            plans.append(plan)
            at += n
        closed = iter(self.learn(joins))
        return [b"".join([next(closed) if isinstance(x, str) else x for x in plan]) for plan in plans]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids, special tokens included."""
        if not self.plain:
            return pa.array([self.lib.decode(x, skip_special_tokens=False) for x in ids.to_pylist()], pa.string())
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.words.take(ids.values)), " ")


def listed(ids: list[bytes]) -> pa.ListArray:
    off = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.Array.from_buffers(pa.int32(), int(off[-1]), [None, pa.py_buffer(b"".join(ids))]))


FIELDS = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]


def encoded(docs: DataFrame, path: str | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), mean: int = MEAN) -> DataFrame:
    """`keep`, ids (array of int) and decoded (the ids decoded again) of each whole text.

    path: a tokenizer file that workers can read; as a default they look up the public one.
    """

    def make():
        encoder = Encoder(path or public_path("word_bpe_49k.json"), mean)

        def run(texts: pa.Array) -> list[pa.Array]:
            gc.disable()  # millions of new tuples without a cycle
            ids = listed(encoder.encode(*flat_utf8(texts)))
            gc.enable()
            return [ids, encoder.decode(ids)]

        return run

    return map_texts(docs, text_col, list(keep), FIELDS, make, AT_ONCE)


def decoded(df: DataFrame, path: str | None = None, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and decoded: the text of an array of ids; null for a null array."""
    src = df.select(*keep, F.col(ids_col).cast("array<int>").alias("__ids"))

    def run(batches):
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path or public_path("word_bpe_49k.json"))
        for b in batches:
            out = [None if x is None else lib.decode([i for i in x if i is not None], skip_special_tokens=False) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out, pa.string())], names=[*keep, "decoded"])

    return src.mapInArrow(run, T.StructType([*src.schema.fields[:-1], FIELDS[1]]))


def digests(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_tokens, ids_sha256 and decoded_sha256 of encoded rows."""
    return df.select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op4(docs: DataFrame) -> DataFrame:
    return digests(encoded(docs))
