"""Ogg media columns (operator 10): paging, checksums, packets from lacing values, logical streams, timestamps.

``encode`` multiplexes two logical streams into one file: unsigned 8-bit mono samples (the payload, whose granule
position counts samples) and a comment stream with the payload's unpadded size. ``decode`` reads any such physical
stream: it verifies the checksum of every page, reassembles packets from lacing values across pages, separates
streams by serial number and dates packets by granule positions. A page's position is that after the last packet that
ends on it; the packets before it are dated by counting the samples of those after them back, where the stream's own
header tells what a sample is. A stream's kind and rate come from its header, its first packet.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, written

RATE = 8000
PACKET = 4000
PACKETS_PER_PAGE = 8
AUDIO, NOTES = 1, 2
SAMPLES, COMMENT = b"U8PCM", b"NOTES"
#: Fixed values of the Ogg page format.
CAPTURE, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, unreflected, from zero: zlib's on mirrored bits, started so that it is zero."""
    raw = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_MIRROR), "big")


def lacing(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def page(serial: int, number: int, granule: int, flags: int, laces: bytes, body: bytes) -> bytes:
    p = bytearray(HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(laces)) + laces + body)
    p[22:26] = page_crc(bytes(p)).to_bytes(4, "little")
    return bytes(p)


def stream_pages(serial: int, packets: list[tuple[bytes, int]], per_page: int = PACKETS_PER_PAGE) -> list[bytes]:
    """Pages of a logical stream from (packet, granule after it); the first packet has a page of its own, and packets
    that need more than 255 lacing values go on in further pages."""
    plan, laces, body, granule, n, flags = [], b"", b"", NO_GRANULE, 0, 0

    def close(next_flags: int) -> None:
        nonlocal laces, body, granule, n, flags
        plan.append((granule, flags, laces, body))
        laces, body, granule, n, flags = b"", b"", NO_GRANULE, 0, next_flags

    for k, (data, after) in enumerate(packets):
        values, at = lacing(len(data)), 0
        while True:
            take = values[: 255 - len(laces)]
            size = sum(take)
            laces, body, values, at = laces + take, body + data[at : at + size], values[len(take) :], at + size
            if not values:
                break
            close(CONTINUED)
        granule, n = after, n + 1
        if k == 0 or n == per_page or len(laces) == 255:
            close(0)
    if laces:
        close(0)
    last = len(plan) - 1
    return [page(serial, i, g, f | FIRST * (i == 0) | LAST * (i == last), v, b) for i, (g, f, v, b) in enumerate(plan)]


def pad64(data: bytes) -> bytes:
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def encode(payload: bytes, n_bytes: int, rate: int = RATE) -> bytes:
    """A physical stream that holds ``payload`` as samples, and its unpadded size in a comment."""
    audio = [(SAMPLES + struct.pack("<IBQ", rate, 1, len(payload)), 0)]
    audio += [(payload[k : k + PACKET], min(k + PACKET, len(payload))) for k in range(0, len(payload), PACKET)]
    notes = [(COMMENT + struct.pack("<Q", n_bytes), 0), (b"end", len(payload))]
    a, b = stream_pages(AUDIO, audio), stream_pages(NOTES, notes)
    return b"".join([a[0], b[0], *a[1:], *b[1:]])


@dataclass
class Stream:
    """``kind`` is that of the header (its first five bytes), empty if the stream's first page is lost or names no kind
    known here; ``data`` leaves a known header out."""

    rate: int
    packets: list[tuple[bytes, float | None]] = field(default_factory=list)
    partial: bytes | None = None
    number: int = 0
    kind: bytes = b""
    started: bool = False
    ended: bool = False

    @property
    def data(self) -> list[tuple[bytes, float | None]]:
        return self.packets[1:] if self.kind else self.packets

    def head(self, packet: bytes) -> None:
        if packet[:5] == SAMPLES and len(packet) >= 18 and (rate := struct.unpack_from("<I", packet, 5)[0]):
            self.kind, self.rate = SAMPLES, rate
        elif packet[:5] == COMMENT and len(packet) >= 13:
            self.kind = COMMENT

    def span(self, packet: bytes) -> int | None:
        """Samples of a packet: its bytes, none in a comment; not known otherwise."""
        return len(packet) if self.kind == SAMPLES else 0 if self.kind == COMMENT else None

    def add(self, done: list[bytes], granule: int) -> None:
        """Packets that end on a page, and its granule position."""
        if done and self.started and not self.packets:
            self.head(done[0])
        after: list[int | None] = [granule if granule >= 0 else None]
        for p in reversed(done[1:]):
            n = self.span(p)
            after.append(None if n is None or after[-1] is None else after[-1] - n)
        self.packets += [(p, None if a is None else max(0, a) / self.rate) for p, a in zip(done, reversed(after))]


@dataclass
class Demuxed:
    streams: dict[int, Stream]
    pages: int
    bad: int
    gaps: int

    def of(self, kind: bytes) -> Stream | None:
        """The first stream of a kind; for samples, if the header is lost, the only stream without a known kind."""
        found = [s for s in self.streams.values() if s.kind == kind]
        lost = [s for s in self.streams.values() if not s.kind] if kind == SAMPLES and not found else []
        return found[0] if found else lost[0] if len(lost) == 1 else None


def decode(media: bytes | None, rate: int = RATE) -> Demuxed:
    """Packets and their times in seconds by serial number. Pages with a wrong checksum are skipped and counted, as
    are gaps in page numbers; a packet cut by either is dropped. Bytes between pages are passed over. ``rate`` is for
    streams whose header names none."""
    out = Demuxed({}, 0, 0, 0)
    media = media or b""
    at = media.find(CAPTURE)
    while at >= 0 and at + HEADER.size <= len(media):
        _, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        values = media[at + HEADER.size : at + HEADER.size + n]
        end = at + HEADER.size + n + sum(values)
        whole = media[at:end]
        if version or len(values) < n or end > len(media) or page_crc(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            out.bad += 1
            at = media.find(CAPTURE, at + 1)
            continue
        out.pages += 1
        s = out.streams.setdefault(serial, Stream(rate, number=number, started=bool(flags & FIRST)))
        if number != s.number:
            out.gaps += 1
            s.partial = None
        s.number = number + 1
        skip = bool(flags & CONTINUED) and s.partial is None
        data = s.partial if flags & CONTINUED and s.partial is not None else b""
        s.partial = None
        body, done = at + HEADER.size + n, []
        run = 0
        for v in values:
            run += v
            if v < 255:
                data += media[body : body + run]
                if not skip:
                    done.append(data)
                body, run, data, skip = body + run, 0, b"", False
        if values and values[-1] == 255:
            s.partial = None if skip else data + media[body : body + run]
        s.add(done, granule)
        s.ended |= bool(flags & LAST)
        at = media.find(CAPTURE, end)
    return out


def read_back(media: bytes | None) -> tuple[bytes, int, Demuxed]:
    """Payload, unpadded size (0 if the comment is lost) and all else from the stored bytes alone."""
    d = decode(media)
    audio, notes = d.of(SAMPLES), d.of(COMMENT)
    payload = b"".join(p for p, _ in audio.data) if audio else b""
    size = struct.unpack_from("<Q", notes.packets[0][0], 5)[0] if notes else 0
    return payload, size, d


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media``: each text's UTF-8 bytes, padded to a multiple of 64, as an Ogg stream. Null is empty."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([encode(pad64(r), len(r)) for r in raw], pa.binary())], names=["doc_id", "media"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, media binary")


def duration(d: Demuxed) -> float:
    audio = d.of(SAMPLES)
    return max((t for _, t in audio.packets if t is not None), default=0.0) if audio else 0.0


def feature(payload: bytes, d: Demuxed) -> str:
    """Duration, packets, mean level and zero crossings about mid level of the samples, as text."""
    x = np.frombuffer(payload, np.uint8)
    level = float(x.mean()) if len(x) else 0.0
    above = x >= 128
    return f"seconds={duration(d):.4f};packets={sum(len(s.packets) for s in d.streams.values())};mean={level:.4f};crossings={int((above[1:] != above[:-1]).sum())}"


def media_features(media: DataFrame) -> DataFrame:
    """Read stored streams (``doc_id, media``) back: sizes, digests, faults and features of each row.

    A null or unreadable stream gives an empty payload and its counts of pages and faults.
    """
    prepare(media.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pages", "bad_pages", "seconds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(1).to_pylist():
                p, n, d = read_back(m)
                m = m or b""
                rows.append((n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(p, d), d.pages, d.bad, duration(d)))
            cols = list(zip(*rows)) if rows else [()] * 10
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages long, bad_pages long, seconds double")


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the media column to the shared folder as a table, and compute from the stored bytes."""
    return media_features(written(media_column(docs, id_col, text_col), "media"))


def packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row per packet of every logical stream: ``doc_id, serial, packet_no, data, seconds``."""
    prepare(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, m in enumerate(b.column(1).to_pylist()):
                rows = [(s, i, p, t) for s, x in sorted(decode(m).streams.items()) for i, (p, t) in enumerate(x.packets)]
                if rows:
                    s, i, p, t = zip(*rows)
                    yield pa.record_batch([b.column(0).take(pa.array([k] * len(rows))), pa.array(s, pa.int64()), pa.array(i, pa.int64()), pa.array(p, pa.binary()), pa.array(t, pa.float64())], names=["doc_id", "serial", "packet_no", "data", "seconds"])

    src = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, serial long, packet_no long, data binary, seconds double")
