"""MPEG audio columns: writing payloads into Layer III streams, and reading any MPEG-1, 2 or 2.5 audio stream.

``pack`` stores bytes in the ancillary part of silent, checksummed Layer III frames (576 bytes of payload each, 1152
samples at 48 kHz), behind an ID3v2 tag and a table frame (``Xing``/``Info``: frames, bytes, seek table) and before an
ID3v1 tag. ``scan`` walks a stream frame by frame: it skips tags, follows frame headers, resynchronises behind junk
(a header counts once the header it points to agrees, or the stream ends there), parses ``Xing``, ``Info`` and ``VBRI``
tables, verifies the checksum of each protected Layer III frame, and returns the exact duration (samples and rate)
and the byte offset of every frame. ``unpack`` reads the ancillary payload back.

Defined results: a null text is empty, and an empty one one block of padding; a null or empty stream has no frames; junk and cut
frames are counted, not fatal; equal payloads give equal streams. Texts are stored whole; repeated rows count each for itself; an empty
table gives an empty one; other columns stay, but for those named like a new one, which give way to it.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import beside, map_texts, ship, slices

#: Kilobits a second by (version 1?, layer), index 1 to 14; sample rates of MPEG-1.
KBITS = {
    (True, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = [44100, 48000, 32000]

UNIT = 576


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2, or 25
    layer: int
    protected: bool
    kbits: int
    rate: int
    padding: int
    mono: bool

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 1 else 576

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12_000 * self.kbits // self.rate + self.padding) * 4
        return self.samples // 8 * 1000 * self.kbits // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)

    @property
    def data_at(self) -> int:
        """Where the side information begins."""
        return 4 + 2 * self.protected


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """The header in four bytes, if they are one. Free-format streams, which tell no frame size, aren't taken for headers."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = {0: 25, 2: 2, 3: 1}.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    bits, rate = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or bits in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    return Header(version, layer, not four[1] & 1, KBITS[version == 1, layer][bits - 1], RATES[rate] // {1: 1, 2: 2, 25: 4}[version], four[2] >> 1 & 1, four[3] >> 6 == 3)


@lru_cache(65536)
def crc16(data: bytes) -> int:
    """Of two header bytes and the side information; polynomial 0x8005 from 0xFFFF on."""
    c = 0xFFFF
    for b in data:
        c ^= b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
    return c


def _frame(kbits: int, body: bytes) -> bytes:
    """A protected silent mono MPEG-1 Layer III frame at 48 kHz; its granules use no bits, so ``body`` is ancillary."""
    index = KBITS[True, 3].index(kbits) + 1
    head = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    side = bytes(17)
    size = header(head).size
    return (head + crc16(head[2:] + side).to_bytes(2, "big") + side + body).ljust(size, b"\0")


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def pack(payload: bytes, kbits: int = 224) -> bytes:
    """A stream that holds ``payload``, whose size is a positive multiple of ``UNIT``."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload isn't a positive multiple of 576 bytes")
    frames = [_frame(kbits, payload[i : i + UNIT]) for i in range(0, len(payload), UNIT)]
    step, total = len(frames[0]), (len(frames) + 1) * len(frames[0])
    toc = bytes(min(255, 256 * step * (k * (len(frames)) // 100 + 1) // total) for k in range(100))
    table = b"Info" + (15).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc + (0).to_bytes(4, "big")
    value = b"\0payload\0" + str(len(payload)).encode()
    note = b"TXXX" + _synchsafe(len(value)) + b"\0\0" + value
    return b"ID3\4\0\0" + _synchsafe(len(note)) + note + _frame(kbits, table) + b"".join(frames) + b"TAG" + b"payload".ljust(124, b"\0") + b"\xff"


@dataclass
class Scan:
    frames: int = 0
    samples: int = 0
    rate: int = 0
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    heads: list[Header] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    table: str | None = None
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: list[int] | None = None
    table_ok: bool | None = None
    crc_ok: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    junk: int = 0
    delay: int = 0
    variable: bool = False

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0

    def seek(self, sample: int) -> int:
        """The byte offset of the frame that holds a sample."""
        return self.offsets[min(self.frames - 1, sample // (self.samples // self.frames))]


def _table(s: Scan, data: bytes, at: int, h: Header) -> bool:
    """Takes a table frame at ``at`` in, if it is one."""
    p = at + h.data_at + h.side if h.layer == 3 else at + 36
    for q in dict.fromkeys((p, p - 2 * h.protected)):  # some writers count no checksum here
        if data[q : q + 4] in (b"Xing", b"Info"):
            s.table, flags, q = data[q : q + 4].decode(), int.from_bytes(data[q + 4 : q + 8], "big"), q + 8
            if flags & 1:
                s.table_frames, q = int.from_bytes(data[q : q + 4], "big"), q + 4
            if flags & 2:
                s.table_bytes, q = int.from_bytes(data[q : q + 4], "big"), q + 4
            if flags & 4:
                s.toc, q = list(data[q : q + 100]), q + 100
            q += 4 * (flags >> 3 & 1)
            if data[q : q + 4] in (b"LAME", b"Lavc", b"Lavf"):
                s.delay = int.from_bytes(data[q + 21 : q + 24], "big")
            return True
    if data[at + 36 : at + 40] == b"VBRI":
        n, scale, wide, each = (int.from_bytes(data[at + 54 + 2 * i : at + 56 + 2 * i], "big") for i in range(4))
        s.table, s.table_bytes, s.table_frames = "VBRI", int.from_bytes(data[at + 46 : at + 50], "big"), int.from_bytes(data[at + 50 : at + 54], "big")
        s.toc = [scale * int.from_bytes(data[at + 62 + wide * i : at + 62 + wide * (i + 1)], "big") for i in range(n)] if each else None
        return True
    return False


def _agrees(a: Header, b: Header | None) -> bool:
    return b is not None and (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


def scan(data: bytes) -> Scan:
    s, at, end = Scan(), 0, len(data)
    if data[-128:-125] == b"TAG":
        s.tags, end = ["ID3v1"], end - 128
    if data[max(0, end - 32) : end - 24] == b"APETAGEX":
        s.tags.append("APEv2")
        whole = int.from_bytes(data[end - 20 : end - 16], "little") + 32 * (data[end - 9] >> 7)
        end = max(0, end - whole)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        n = 0
        for b in data[at + 6 : at + 10]:
            n = n << 7 | b & 0x7F
        s.tags.append(f"ID3v2.{data[at + 3]}")
        at += 10 + n + 10 * (data[at + 5] >> 4 & 1)
    begin, last, lost = at, None, False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h is not None and at + h.size <= end and (last is None or _agrees(last, h)):
            behind = at + h.size
            sure = last is not None and not lost or behind == end or _agrees(h, header(data[behind : behind + 4]))
        else:
            sure = False
        if not sure:
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            s.junk, at, s.resyncs, lost = s.junk + found - at, found, s.resyncs + (not lost), True
            continue
        lost = False
        if h.protected and h.layer == 3:
            good = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == int.from_bytes(data[at + 4 : at + 6], "big")
            s.crc_ok, s.crc_bad = s.crc_ok + good, s.crc_bad + (not good)
        if last is not None or not _table(s, data, at, h):
            s.offsets.append(at)
            s.sizes.append(h.size)
            s.heads.append(h)
            s.samples += h.samples
            s.variable |= h.kbits != s.heads[0].kbits
        last, at = h, at + h.size
    s.junk += max(0, end - at)
    s.frames, s.rate = len(s.offsets), last.rate if last else 0
    if s.table:
        s.table_ok = s.table_frames in (None, s.frames) and s.table_bytes in (None, at - begin)
    return s


def unpack(data: bytes, s: Scan | None = None) -> bytes:
    """The ancillary payload of a stream that ``pack`` made."""
    s = s or scan(data)
    return b"".join([data[p : p + UNIT] for p in (at + h.data_at + h.side for at, h in zip(s.offsets, s.heads, strict=True))])


def store(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 text of each row, padded with bytes 255 to whole frames, as a stream."""

    def work():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            raw = [t.encode() for t in part.column(1).to_pylist()]
            media = [pack(b + b"\xff" * (-len(b) % UNIT if b else UNIT)) for b in raw]
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], [doc_id, "n_bytes", "media"])

        return step

    return map_texts(df, [doc_id], text, work, f"`{doc_id}` {df.schema[doc_id].dataType.simpleString()}, n_bytes long, media binary")


PROBED = "frames long, samples long, rate int, seconds double, variable boolean, vbr_table string, table_frames long, table_ok boolean, crc_ok long, crc_bad long, resyncs long, junk_bytes long, tags array<string>, frame_offsets array<long>, payload binary"


def probe(df: DataFrame, media: str = "media") -> DataFrame:
    """All columns of ``df``, and what the stream in ``media`` holds; a stream that ``pack`` didn't make has a meaningless payload."""
    ship()
    names = [x.split()[0] for x in PROBED.split(", ")]
    keep, kept = beside(df, *names)
    df = df.select(*[F.col(c) for c in keep])
    at, schema = keep.index(media), kept + PROBED
    types = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                rows = []
                for data in part.column(at).to_pylist():
                    s = scan(data or b"")
                    rows.append((s.frames, s.samples, s.rate, s.seconds, s.variable, s.table, s.table_frames, s.table_ok, s.crc_ok, s.crc_bad, s.resyncs, s.junk, s.tags, s.offsets, unpack(data or b"", s)))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], [*part.schema.names, *names])

    return df.mapInArrow(run, schema)


def digest(payload: bytes) -> tuple[str, int]:
    return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])
