"""MPEG transport streams (ISO/IEC 13818-1): writing and reading 8-bit sample payloads.

``mux`` stores a byte string as one elementary stream in one program; ``demux`` reads any transport stream with
188-byte packets: it parses the program association and map tables, checks sync bytes, section CRCs and continuity
counters, reassembles the elementary packets and lists timestamps with random-access points.

Defined cases: null and empty texts have an n_bytes of 0 and a payload of 64 zero bytes; the longest text is handled
in memory of its own size times a small constant; equal texts give equal rows; an empty table gives no rows; a kept column
that is named as a result gives way to it.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import flat_utf8, map_texts

PACKET, SYNC = 188, 0x47
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0100, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in PES packets
UNIT = 4096  # samples in an access unit
RATE, CLOCK = 8000, 90_000  # samples and timestamp ticks in a second
RAP_EVERY = 8  # access units between random-access points
PES_HEAD = 14


def crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32) << np.uint32(24)
    for _ in range(8):
        c = np.where(c >> np.uint32(31), (c << np.uint32(1)) ^ np.uint32(0x04C11DB7), c << np.uint32(1)).astype(np.uint32)
    return c


_CRC = [int(x) for x in crc_table()]


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ext.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


def tables() -> bytes:
    """A PAT and a PMT packet for one program with one stream, whose PID also carries the clock."""
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    es = bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + es)
    return _table_packet(0, pat) + _table_packet(PMT_PID, pmt)


_TABLES = tables()


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + length[0] - 1, start[1] .. and so on."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def mux(payload: np.ndarray) -> bytes:
    """The transport stream that holds these samples: an access unit for each 4096, with a timestamp and clock."""
    n = len(payload)
    starts = np.arange(0, max(n, 1), UNIT)
    units = len(starts)
    sizes = np.minimum(UNIT, n - starts)
    pts = starts * CLOCK // RATE
    total = sizes + PES_HEAD
    first = np.minimum(total, PACKET - 4 - 8)  # the first packet has an adaptation field with the clock
    more = -(-(total - first) // (PACKET - 4))
    count = 1 + more
    at = np.cumsum(count) - count
    packets = int(count.sum())

    es = np.empty(n + units * PES_HEAD, np.uint8)
    head = np.zeros((units, PES_HEAD), np.uint8)
    head[:, 2], head[:, 3], head[:, 6], head[:, 7], head[:, 8] = 1, STREAM_ID, 0x84, 0x80, 5
    head[:, 4], head[:, 5] = (sizes + 8) >> 8, (sizes + 8) & 255
    head[:, 9] = 0x21 | ((pts >> 29) & 14)
    head[:, 10], head[:, 11] = (pts >> 22) & 255, ((pts >> 14) & 254) | 1
    head[:, 12], head[:, 13] = (pts >> 7) & 255, ((pts << 1) & 254) | 1
    begin = np.cumsum(total) - total
    es[(begin[:, None] + np.arange(PES_HEAD)).ravel()] = head.ravel()
    es[_runs(begin + PES_HEAD, sizes)] = payload

    out = np.full((packets, PACKET), 255, np.uint8)
    start = np.zeros(packets, bool)
    start[at] = True
    fill = np.full(packets, PACKET - 4, np.int64)
    fill[at] = first
    last = at + more
    tail = total - first - (more - 1) * (PACKET - 4)
    fill[last[more > 0]] = tail[more > 0]
    out[:, 0] = SYNC
    out[:, 1] = (ES_PID >> 8) | np.where(start, 0x40, 0)
    out[:, 2] = ES_PID & 255
    field_len = PACKET - 4 - fill
    out[:, 3] = np.where(field_len > 0, 0x30, 0x10) | (np.arange(packets) & 15)
    has = field_len > 0
    out[has, 4] = field_len[has] - 1
    flagged = field_len > 1
    out[flagged, 5] = 0
    out[at, 5] = 0x10 | np.where(np.arange(units) % RAP_EVERY == 0, 0x40, 0)
    out[at, 6], out[at, 7] = (pts >> 25) & 255, (pts >> 17) & 255
    out[at, 8], out[at, 9] = (pts >> 9) & 255, (pts >> 1) & 255
    out[at, 10], out[at, 11] = ((pts & 1) << 7) | 0x7E, 0
    row = np.arange(packets) * PACKET
    out.reshape(-1)[_runs(row + PACKET - fill, fill)] = es
    return _TABLES + out.tobytes()


@dataclass
class Stream:
    pid: int
    kind: int
    payload: bytes = b""
    pts: list[int] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)
    units: int = 0
    bad_units: int = 0


@dataclass
class Read:
    packets: int = 0
    bad_sync: int = 0
    discontinuities: int = 0
    bad_sections: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: list[Stream] = field(default_factory=list)


def _sections(rows: np.ndarray, begin: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The sections that these packets of one PID carry, reassembled across packets."""
    data, marks = bytearray(), []
    for r, b, s in zip(rows, begin, starts, strict=True):
        body = r[b:].tobytes()
        if s:
            marks.append(len(data) + body[0])
            body = body[1:]
        data += body
    found = []
    for m in marks:
        while m + 3 <= len(data) and data[m] != 0xFF:
            end = m + 3 + (int.from_bytes(data[m + 1 : m + 3], "big") & 0xFFF)
            if end > len(data):
                break
            found.append(bytes(data[m:end]))
            m = end
    return list(dict.fromkeys(found))


def demux(data: bytes) -> Read:
    """Read a transport stream; packets without a sync byte, a payload or a known PID count, but give no data."""
    got = Read()
    n = len(data) // PACKET
    p = np.frombuffer(data, np.uint8, n * PACKET).reshape(n, PACKET)
    got.packets = n
    ok = p[:, 0] == SYNC
    got.bad_sync = int((~ok).sum())
    if got.bad_sync:
        p = p[ok]
    pid = ((p[:, 1].astype(np.int32) & 0x1F) << 8) | p[:, 2]
    start = (p[:, 1] & 0x40) > 0
    control = p[:, 3] >> 4
    adapt, has = (control & 2) > 0, (control & 1) > 0
    begin = 4 + np.where(adapt, p[:, 4].astype(np.int32) + 1, 0)
    flags = np.where(adapt & (p[:, 4] > 0), p[:, 5], 0)
    has &= begin < PACKET
    counter = p[:, 3] & 15

    def whole(of: int) -> np.ndarray:
        """Rows of a PID with payload, without repeats; counts gaps that no discontinuity flag announces."""
        at = np.flatnonzero((pid == of) & has)
        if len(at) > 1:
            step = (counter[at][1:].astype(np.int32) - counter[at][:-1]) & 15
            again = (step == 0) & (p[at[1:], 4:] == p[at[:-1], 4:]).all(1)
            got.discontinuities += int(((step != 1) & ~again & ((flags[at[1:]] & 0x80) == 0)).sum())
            at = at[np.r_[True, ~again]]
        return at

    def sections(of: int, table_id: int) -> list[bytes]:
        at = whole(of)
        out = []
        for s in _sections(p[at], begin[at], start[at]):
            if len(s) < 12 or section_crc(s):
                got.bad_sections += 1
            elif s[0] == table_id:
                out.append(s)
        return out

    for s in sections(0, 0):
        for i in range(8, len(s) - 4, 4):
            number = int.from_bytes(s[i : i + 2], "big")
            if number:
                got.programs[number] = int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF
    for pmt in dict.fromkeys(got.programs.values()):
        for s in sections(pmt, 2):
            i = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while i + 5 <= len(s) - 4:
                es = int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF
                got.streams.append(_elementary(Stream(es, s[i]), p, whole(es), begin, start, flags))
                i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0xFFF)
    return got


def _elementary(s: Stream, p: np.ndarray, at: np.ndarray, begin: np.ndarray, start: np.ndarray, flags: np.ndarray) -> Stream:
    heads = np.flatnonzero(start[at])
    if not len(heads):
        return s
    at = at[heads[0] :]
    heads = heads - heads[0]
    length = (PACKET - begin[at]).astype(np.int64)
    es = p.reshape(-1)[_runs(at * PACKET + begin[at], length)]
    ends = np.cumsum(length)
    first = (ends - length)[heads]
    stop = np.r_[first[1:], len(es)]
    s.units = len(heads)
    room = stop - first
    h = es[np.minimum(first[:, None] + np.arange(PES_HEAD), len(es) - 1)].astype(np.int64)
    good = (room >= 9) & (h[:, 0] == 0) & (h[:, 1] == 0) & (h[:, 2] == 1)
    size = (h[:, 4] << 8) | h[:, 5]
    size = np.where(size == 0, room - 6, size)
    good &= size + 6 <= room
    skip = 9 + h[:, 8]
    stamped = good & ((h[:, 7] & 0x80) > 0)
    pts = ((h[:, 9] >> 1) & 7) << 30 | h[:, 10] << 22 | (h[:, 11] >> 1) << 15 | h[:, 12] << 7 | h[:, 13] >> 1
    s.pts = [int(x) if k else -1 for x, k in zip(pts, stamped, strict=True)]
    s.random_access = [bool(x) for x in (flags[at[heads]] & 0x40) > 0]
    s.bad_units = int((~good).sum())
    take = np.where(good, np.maximum(size + 6 - skip, 0), 0)
    s.payload = es[_runs(first + skip, take)].tobytes()
    return s


FIELDS = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
]
MEDIA = [T.StructField("media", T.BinaryType())]
POINTS = [T.StructField("points", T.ArrayType(T.StructType([T.StructField("pts", T.LongType()), T.StructField("random_access", T.BooleanType())])))]


def feature(r: Read, s: Stream, samples: np.ndarray) -> str:
    mean = int(samples.sum(dtype=np.int64)) * 1000 // len(samples)
    return f"packets={r.packets};units={s.units};rap={sum(s.random_access)};pts={s.pts[0]}-{s.pts[-1]};gaps={r.discontinuities};bad={r.bad_sync + r.bad_sections + s.bad_units};mean_milli={mean}"


def stored_texts(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_media: bool = False, with_points: bool = False) -> DataFrame:
    """Store each whole text as a transport stream, read the stored bytes back and describe what was read.

    with_media adds the stored bytes (``media``), with_points the timestamps and random-access flags (``points``).
    """

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            data, off = flat_utf8(texts)
            rows, media, points = [], [], []
            for lo, hi in zip(off[:-1], off[1:], strict=True):
                n = int(hi - lo)
                padded = max(64, -(-n // 64) * 64)
                body = np.zeros(padded, np.uint8)
                body[:n] = data[lo:hi]
                stored = mux(body)
                got = demux(stored)
                es = got.streams[0]
                back = es.payload
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(got, es, np.frombuffer(back, np.uint8))))
                if with_media:
                    media.append(stored)
                if with_points:
                    points.append([{"pts": t, "random_access": k} for t, k in zip(es.pts, es.random_access, strict=True)])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            out = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            if with_media:
                out.append(pa.array(media, pa.binary()))
            if with_points:
                out.append(pa.array(points, pa.list_(pa.struct([("pts", pa.int64()), ("random_access", pa.bool_())]))))
            return out

        return run

    return map_texts(df, text_col, list(keep), FIELDS + MEDIA * with_media + POINTS * with_points, make)
