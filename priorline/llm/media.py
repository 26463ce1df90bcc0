"""MPEG audio: payloads in a valid frame stream, and a reader for such streams.

``wrap`` makes an MPEG-1 Layer III stream (320 or 256 kbit/s in turn, 32 kHz, stereo, CRC-protected): an ID3v2 tag
with the payload's length, a Xing frame with the variable-bitrate table, then frames whose main data
hold the payload. ``read_stream`` resynchronises on frame headers, skips tags and junk between frames,
parses the table, verifies each checksum, and gives exact duration, frame seek offsets and the payload.

Defined cases: a null text is an empty one; the payload is the UTF-8 text and zero bytes up to a
positive multiple of 64, so an empty text gives 64 zero bytes; equal texts give equal streams; rows that
repeat stay; an empty table gives no rows; further columns are ignored; a stream may have any length, as
frames are added one by one; the seek offsets are those of all frames.

``media_column`` gives the streams as a column, ``audio_features`` writes it and derives everything else from
the streams it reads back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from priorline.llm.common import pieces
from priorline.session import materialize

# Fixed values of MPEG-1 Layer III: kbit/s by index, Hz by index, samples in a frame, bytes of side information.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES = (44100, 48000, 32000)
SAMPLES = 1152
SIDE_STEREO, SIDE_MONO = 32, 17

UNIT = 64
RATE_INDEX = 2
#: Bitrate indices that the payload's frames take in turn: a stream of variable bitrate.
TURN = (14, 13)
#: Bytes of texts or streams that are worked on at once.
AT_ONCE = 8_000_000
ROW = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, duration_ms double, n_frames long, seek_offsets array<long>"
)


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ (0x8005 if c & 0x8000 else 0)
        table.append(c & 0xFFFF)
    return table


_CRC = _crc_table()


def frame_crc(data: bytes) -> int:
    """CRC-16 of polynomial 0x8005 from 0xFFFF, over the header's last two bytes and the side information."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


def frame_bytes(bitrate_index: int, rate_index: int, padded: bool) -> int:
    return 144_000 * BITRATES[bitrate_index] // RATES[rate_index] + padded


def _head(bitrate_index: int) -> bytes:
    """Header, checksum and side information of a stereo frame without padding, the checksum correct."""
    header = bytes((0xFF, 0xFA, bitrate_index << 4 | RATE_INDEX << 2, 0x00))
    side = bytes(SIDE_STEREO)
    return header + struct.pack(">H", frame_crc(header[2:] + side)) + side


_HEADS = {i: _head(i) for i in range(1, 15)}
_ROOM = {i: frame_bytes(i, RATE_INDEX, False) - len(_HEADS[i]) for i in _HEADS}


def _syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def wrap(payload: bytes) -> bytes:
    """The payload as an MPEG stream with tag and variable-bitrate table."""
    note = b"\x00payload_bytes\x00" + str(len(payload)).encode()
    body = b"TXXX" + _syncsafe(len(note)) + b"\x00\x00" + note
    tag = b"ID3\x04\x00\x00" + _syncsafe(len(body)) + body
    frames, offsets, at, k = [], [], 0, 0
    position = first = frame_bytes(TURN[0], RATE_INDEX, False)
    while at < len(payload):
        index = TURN[k % len(TURN)]
        room = _ROOM[index]
        frames.append(_HEADS[index] + payload[at : at + room].ljust(room, b"\x00"))
        offsets.append(position)
        position += len(frames[-1])
        at, k = at + room, k + 1
    total = position
    toc = bytes(min(255, 256 * offsets[len(offsets) * i // 100] // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return tag + (_HEADS[TURN[0]] + table).ljust(first, b"\x00") + b"".join(frames)


@dataclass
class Stream:
    """What read_stream found."""

    tags: dict[str, str] = field(default_factory=dict)
    table: tuple[int, int] | None = None
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    bad_checksums: int = 0
    skipped: int = 0
    payload: bytes = b""

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def _header(data: bytes, at: int) -> tuple[int, int, bool, bool] | None:
    """(bytes, Hz, protected, mono) of the frame header at ``at``, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xFA:
        return None
    b, r = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if b in (0, 15) or r == 3:
        return None
    return frame_bytes(b, r, bool(data[at + 2] & 2)), RATES[r], not data[at + 1] & 1, data[at + 3] >> 6 == 3


def _tag(data: bytes, at: int, found: Stream) -> int:
    """Reads the ID3v2 tag at ``at``; its length, 0 where there is none."""
    if data[at : at + 3] != b"ID3" or at + 10 > len(data):
        return 0
    size = 0
    for b in data[at + 6 : at + 10]:
        size = size << 7 | b & 0x7F
    i, end = at + 10, min(at + 10 + size, len(data))
    while i + 10 <= end and data[i] != 0:
        n = 0
        for b in data[i + 4 : i + 8]:
            n = n << 7 | b & 0x7F
        if data[i : i + 4] == b"TXXX" and n:
            key, _, value = data[i + 11 : i + 10 + n].partition(b"\x00")
            found.tags[key.decode("latin-1")] = value.decode("latin-1")
        i += 10 + n
    return 10 + size


def read_stream(data: bytes) -> Stream:
    """Reads a stream from any start: a header counts as one if another header, a tag or the end follows
    its frame. Frames with a wrong checksum are counted and keep their time, their data are left out."""
    found, parts, at, start = Stream(), [], 0, 0
    while at < len(data):
        if n := _tag(data, at, found):
            at += n
            start = at if not found.offsets and found.table is None else start
            continue
        if data[at : at + 3] == b"TAG" and len(data) - at == 128:
            break
        head = _header(data, at)
        after = at + head[0] if head else 0
        if not head or after > len(data) or (after < len(data) and not _header(data, after) and data[after : after + 3] not in (b"ID3", b"TAG")):
            following = min((x for x in (data.find(b"\xff", at + 1), data.find(b"ID3", at + 1)) if x >= 0), default=len(data))
            found.skipped += following - at
            at = following
            continue
        size, rate, protected, mono = head
        side = SIDE_MONO if mono else SIDE_STEREO
        body = at + 4 + 2 * protected + side
        if found.table is None and not found.offsets and data[body : body + 4] in (b"Xing", b"Info"):
            flags, frames, total = struct.unpack(">III", data[body + 4 : body + 16])
            found.table = (frames, total) if flags & 3 == 3 else (0, 0)
        else:
            found.rate = rate
            found.samples += SAMPLES
            found.offsets.append(at - start)
            right = not protected or _stored_crc_holds(data, at, side)
            found.bad_checksums += not right
            if right:
                parts.append(data[body:after])
        at = after
    found.payload = b"".join(parts)
    if "payload_bytes" in found.tags:
        found.payload = found.payload[: int(found.tags["payload_bytes"])]
    return found


_KNOWN_HEADS = frozenset(_HEADS.values())


def _stored_crc_holds(data: bytes, at: int, side: int) -> bool:
    head = data[at : at + 6 + side]
    if head in _KNOWN_HEADS:  # the same bytes, whose checksum has been computed before
        return True
    return frame_crc(head[2:4] + head[6:]) == head[4] << 8 | head[5]


def stored_row(n_bytes: int, media: bytes) -> tuple:
    """ROW without doc_id of one stored stream; ``n_bytes`` is its text's length."""
    got = read_stream(media)
    if got.bad_checksums or got.table is None or got.table[0] != len(got.offsets):
        raise ValueError("a stored stream doesn't read back")
    ms = got.seconds * 1000
    seek_crc = zlib.crc32(",".join(map(str, got.offsets)).encode())
    feature = f"mp3 {got.rate} Hz stereo vbr; frames {len(got.offsets)}; samples {got.samples}; ms {ms:.3f}; seek {seek_crc:08x}"
    return (
        n_bytes, len(got.payload), hashlib.sha256(got.payload).hexdigest(), zlib.crc32(got.payload[-UNIT:]), len(media),
        hashlib.sha256(media).hexdigest(), feature, ms, len(got.offsets), got.offsets,
    )


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    for a, b in pieces(batch.column(column), AT_ONCE):
        for at in range(a, b, 512):
            yield batch.slice(at, min(512, b - at))


def media_column(docs: DataFrame) -> DataFrame:
    """Per document doc_id, n_bytes (of its text) and media, its stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                texts = [(x.as_py() or "").encode() for x in part.column(1)]
                columns = [part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([wrap(payload_of(x)) for x in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def stored_features(stored: DataFrame) -> DataFrame:
    """Columns of ROW and the stream itself from written (doc_id, n_bytes, media)."""
    names = [*(x.split()[0] for x in ROW.split(", ")), "media"]
    types = [pa.int64()] * 2 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2):
                rows = [stored_row(n.as_py(), m.as_py()) for n, m in zip(part.column(1), part.column(2), strict=True)]
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made, part.column(2)], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, f"{ROW}, media binary")


def audio_features(docs: DataFrame) -> DataFrame:
    """Per document its stored stream (media), and the digests, duration and seek offsets of all frames that
    were read from it (columns of ROW)."""
    return stored_features(materialize(media_column(docs), "media"))
