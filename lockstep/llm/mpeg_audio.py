"""MPEG audio columns: a writer that stores bytes in valid Layer III frames, and a reader for any MPEG audio.

The writer makes an ID3v2 tag, a Xing table (the stream has a variable bitrate: the last frame is the smallest that
holds the rest) and protected MPEG-1 Layer III frames at 48 kHz, mono. Side information is all zero, so that a
player plays silence; the bytes lie in the frames' ancillary data, where decoders leave them alone. The unit of
storage is the frame, of which the tag's TXXX entry "payload_bytes" tells how many bytes count.

The reader resynchronises frame headers (a header counts if the next one, where its length says, agrees with it,
or the stream ends there), parses ID3v2, ID3v1, Xing, Info and VBRI, verifies the checksums of Layer III frames and
gives the exact duration in samples and the byte offset of every frame.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

UNIT = 64

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bitrate index 1 to 14, and Hz by sampling index.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {0: (11025, 12000, 8000), 2: (22050, 24000, 16000), 3: (44100, 48000, 32000)}


class Header(NamedTuple):
    version: int  # the two bits: 0 MPEG-2.5, 2 MPEG-2, 3 MPEG-1
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    size: int
    samples: int

    @property
    def stream(self) -> tuple:
        return self.version, self.layer, self.rate


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes; None if they are none, or of free or reserved format."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    bitrate, rate, padding = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3:
        return None
    mpeg1 = version == 3
    kbits, hertz = BITRATES[1 if mpeg1 else 2, layer][bitrate - 1], RATES[version][rate]
    samples = 384 if layer == 1 else 1152 if layer == 2 or mpeg1 else 576
    size = (12_000 * kbits // hertz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hertz + padding
    return Header(version, layer, not four[1] & 1, kbits, hertz, four[3] >> 6 == 3, size, samples)


def side_bytes(h: Header) -> int:
    """Bytes of Layer III side information."""
    return (17 if h.mono else 32) if h.version == 3 else (9 if h.mono else 17)


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """CRC-16 as MPEG audio uses it: polynomial 0x8005, start 0xFFFF, highest bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _id3v2(entries: dict[str, str]) -> bytes:
    body = b""
    for key, value in entries.items():
        data = b"\x03" + key.encode() + b"\0" + value.encode()
        body += b"TXXX" + _syncsafe(len(data)) + b"\0\0" + data
    return b"ID3\x04\0\0" + _syncsafe(len(body)) + body


def _frame_head(index: int, protected: bool = True) -> bytes:
    """Header, checksum and zero side information of a mono Layer III frame at 48 kHz."""
    head = bytes([0xFF, 0xFA | (not protected), index << 4 | 1 << 2, 0xC4])
    side = bytes(17)
    return head + (struct.pack(">H", crc16(head[2:] + side)) if protected else b"") + side


_HEADS = [_frame_head(i) for i in range(1, 15)]
_SIZES = [144 * 1000 * k // 48_000 for k in BITRATES[1, 3]]
_ROOM = [s - len(_HEADS[0]) for s in _SIZES]
_XING_INDEX = 4  # 56 kbit/s: 168 bytes hold the table


def write_audio(payload: bytes) -> bytes:
    """An MPEG audio stream that holds payload."""
    room = _ROOM[-1]
    n_full = len(payload) // room
    full = np.empty((n_full, _SIZES[-1]), np.uint8)
    full[:, : len(_HEADS[-1])] = np.frombuffer(_HEADS[-1], np.uint8)
    full[:, len(_HEADS[-1]) :] = np.frombuffer(payload, np.uint8, n_full * room).reshape(n_full, room)
    rest, last, n_frames = payload[n_full * room :], b"", n_full
    if rest:
        k = next(i for i, r in enumerate(_ROOM) if r >= len(rest))
        last, n_frames = _HEADS[k] + rest.ljust(_ROOM[k], b"\0"), n_full + 1
    audio = full.tobytes() + last
    size = _SIZES[_XING_INDEX - 1]
    total = size + len(audio)
    toc = bytes(min(255, 256 * (size + min(n_frames * i // 100, n_full) * _SIZES[-1]) // total) for i in range(100))
    xing = _frame_head(_XING_INDEX, protected=False) + b"Xing" + struct.pack(">III", 7, n_frames, total) + toc
    return _id3v2({"payload_bytes": str(len(payload))}) + xing.ljust(size, b"\0") + audio


class Audio(NamedTuple):
    tags: dict[str, str]
    table: str | None  # Xing, Info or VBRI
    table_frames: int | None
    table_bytes: int | None
    offsets: list[int]  # of audio frames, the table's own not among them
    kbits: list[int]
    samples: int
    rate: int
    checked: int
    failed: int
    skipped: int  # bytes outside tags and frames
    ancillary: list[tuple[int, int]]  # where each Layer III frame's bytes after its side information lie


def _tags(data: bytes) -> tuple[dict[str, str], int, int]:
    tags: dict[str, str] = {}
    start, end = 0, len(data)
    while data[start : start + 3] == b"ID3" and start + 10 <= end:
        n = sum((b & 127) << s for b, s in zip(data[start + 6 : start + 10], (21, 14, 7, 0), strict=True))
        version, k, stop = data[start + 3], start + 10, min(start + 10 + n, end)
        while k + 10 <= stop and data[k : k + 4].strip(b"\0"):
            raw = data[k + 4 : k + 8]
            size = sum((b & 127) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if version >= 4 else int.from_bytes(raw, "big")
            name, body = data[k : k + 4].decode("latin-1"), data[k + 10 : min(k + 10 + size, stop)]
            if name[:1] == "T" and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                tags[key] = value.rstrip("\0")
            k += 10 + size
        start = start + 10 + n + (10 if data[start + 5] & 16 else 0)
    if data[end - 128 : end - 125] == b"TAG" and end - 128 >= start:
        end -= 128
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(key, value)
    return tags, min(start, end), end


def read_audio(data: bytes) -> Audio:
    """What is in an MPEG audio stream; damaged or foreign bytes are skipped and counted."""
    tags, at, end = _tags(data)
    offsets, kbits, ancillary = [], [], []
    table = table_frames = table_bytes = None
    samples = rate = checked = failed = skipped = 0
    stream, synced = None, False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h is None or at + h.size > end or stream is not None and h.stream != stream:
            h = None
        elif not synced and at + h.size != end:
            after = header(data[at + h.size : at + h.size + 4])
            if after is None or after.stream != h.stream:
                h = None
        if h is None:
            found = data.find(b"\xff", at + 1, end)
            step = (found if found >= 0 else end) - at
            skipped, at, synced = skipped + step, at + step, False
            continue
        synced, stream, rate = True, h.stream, h.rate
        inside = at + 4 + 2 * h.protected
        body = inside + side_bytes(h)
        if not offsets and table is None and h.layer == 3:
            spot = next((s for s in (at + 4 + side_bytes(h), body) if data[s : s + 4] in (b"Xing", b"Info")), None)
            if spot is not None:
                table, flags = data[spot : spot + 4].decode(), int.from_bytes(data[spot + 4 : spot + 8], "big")
                spot += 8
                if flags & 1:
                    table_frames, spot = int.from_bytes(data[spot : spot + 4], "big"), spot + 4
                if flags & 2:
                    table_bytes = int.from_bytes(data[spot : spot + 4], "big")
            elif data[at + 36 : at + 40] == b"VBRI":
                table = "VBRI"
                table_bytes, table_frames = struct.unpack(">II", data[at + 46 : at + 54].ljust(8, b"\0"))
            if table is not None:
                at += h.size
                continue
        if h.layer == 3 and h.protected:
            checked += 1
            failed += crc16(data[at + 2 : at + 4] + data[inside:body]) != int.from_bytes(data[at + 4 : at + 6], "big")
        if h.layer == 3:
            ancillary.append((body, at + h.size))
        offsets.append(at)
        kbits.append(h.kbits)
        samples += h.samples
        at += h.size
    skipped += max(0, end - at)
    return Audio(tags, table, table_frames, table_bytes, offsets, kbits, samples, rate, checked, failed, skipped, ancillary)


def read_payload(data: bytes, audio: Audio) -> bytes:
    """The bytes that write_audio() stored."""
    held = b"".join(data[a:b] for a, b in audio.ancillary)
    return held[: int(audio.tags.get("payload_bytes", len(held)))]


def pad(data: bytes) -> bytes:
    """data with zeros up to a positive multiple of UNIT."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


_STORED = "doc_id long, n_bytes long, media binary"
_READ = f"{_STORED}, payload binary, sample_rate int, samples long, duration_s double, n_frames long, seek_offsets array<long>, bitrates array<int>, vbr_table string, tags map<string,string>, checked long, failed long, skipped long"


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's UTF-8 bytes, padded, as an MPEG audio stream.

    A null text counts as empty: n_bytes 0 and one frame of zeros. Null ids and repeated rows stay, a result each;
    other columns are ignored; an empty table gives an empty one. Equal texts give equal media.
    """
    batches(docs.sparkSession, 500)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [t.encode() if t else b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([write_audio(pad(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _STORED)


def read_media(stored: DataFrame, with_seek: bool = True) -> DataFrame:
    """Reads the streams in media back: payload, exact duration, seek offsets, table, tags, checksums.

    Null media give null results but for id and n_bytes. seek_offsets and bitrates are null without with_seek.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _READ.split(", ")]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.int64(), pa.int64()]
        for batch in rows:
            out = []
            for data in batch.column(2).to_pylist():
                if data is None:
                    out.append((None,) * 12)
                    continue
                a = read_audio(data)
                out.append((read_payload(data, a), a.rate, a.samples, a.samples / a.rate if a.rate else 0.0, len(a.offsets), a.offsets if with_seek else None, a.kbits if with_seek else None, a.table, list(a.tags.items()), a.checked, a.failed, a.skipped))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types[3:], strict=True)] if out else [pa.array([], t) for t in types[3:]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, _READ)


def op8_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    read = read_media(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")), with_seek=True)
    last = F.col("seek_offsets")[F.size("seek_offsets") - 1]
    feature = F.concat_ws(";", F.lit("mpeg1-layer3-mono"), *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in {
        "rate": F.col("sample_rate"), "samples": F.col("samples"), "frames": F.col("n_frames"), "first": F.col("seek_offsets")[0], "last": last,
        "table": F.col("vbr_table"), "checked": F.col("checked"), "failed": F.col("failed"), "skipped": F.col("skipped"),
    }.items()])
    tail = F.expr("substring(payload, -64, 64)")
    return read.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
