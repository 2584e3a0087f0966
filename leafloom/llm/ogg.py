"""Media columns: Ogg.

Writer: payload samples and a small index stream are cut into packets, laced into pages with checksums and granule
positions, and the two logical streams are multiplexed. Reader: every page's checksum is verified, packets are put together
again from the lacing values (over page borders), the logical streams are demultiplexed by serial number, and timestamps
come from the granule positions. A damaged page raises ``OggError``.

Defined results: a null text is an empty one, of which the payload is 64 zero bytes; equal texts give equal media; other
columns are ignored. A worker holds the media of 16 MB of texts at a time, or one medium.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leafloom.llm.common import slices, texts

RATE = 8000  # samples of 8 bits a second
PACKET = 8000  # samples in a packet
SAMPLES, INDEX = 0x5A01, 0x5A02  # serial numbers of the two logical streams
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
HEADER = struct.Struct("<4sBBqIIIB")


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04c11db7, start 0, most significant bit first.

    It is the bit-reversed form of the reflected CRC that zlib has, over bit-reversed bytes and without its inversions.
    """
    plain = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(plain.to_bytes(4, "little").translate(REVERSED), "big")


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    whole = bytearray(head + body)
    struct.pack_into("<I", whole, 22, checksum(bytes(whole)))
    return bytes(whole)


def paged(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[tuple[int, bytes]]:
    """(granule so far, page) of one logical stream; packets: (bytes, granule at its end). The first packet has a page of its own."""
    lacing, body, number, granule, going, reached = bytearray(), bytearray(), 0, -1, False, 0

    def close(last: bool) -> bytes:
        flags = going | (number == 0) << 1 | last << 2
        return page(serial, number, granule, flags, bytes(lacing), bytes(body))

    for k, (data, end) in enumerate(packets):
        at = 0
        while True:
            if len(lacing) == 255:
                yield reached, close(False)
                number, granule, going = number + 1, -1, at > 0
                lacing.clear()
                body.clear()
            step = min(255, len(data) - at)
            # full segments of 255 go in together
            run = min((len(data) - at) // 255, 255 - len(lacing))
            if run:
                lacing += b"\xff" * run
                body += data[at : at + 255 * run]
                at += 255 * run
                continue
            lacing.append(step)
            body += data[at : at + step]
            granule = reached = end
            break
        if k == 0 or k == len(packets) - 1:
            yield reached, close(k == len(packets) - 1)
            number, granule, going = number + 1, -1, False
            lacing.clear()
            body.clear()


def encode(payload: bytes, n_bytes: int) -> bytes:
    """One Ogg medium: 8-bit samples, and an index stream that tells the unpadded size."""
    samples = [(b"\x7fPCM8" + struct.pack("<IQ", RATE, len(payload)), 0)]
    samples += [(payload[k : k + PACKET], min(k + PACKET, len(payload))) for k in range(0, len(payload), PACKET)]
    index = [(b"\x7fINDEX", 0), (struct.pack("<QQ", n_bytes, len(payload)), len(payload))]
    both = [(g, s, k, p) for s, packets in ((SAMPLES, samples), (INDEX, index)) for k, (g, p) in enumerate(paged(s, packets))]
    # beginnings come first, then pages as their time runs
    return b"".join(p for _, _, _, p in sorted(both, key=lambda x: (x[2] > 0, x[0], x[1], x[2])))


def decode(media: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """serial -> [(packet, granule of its page if it is the last to end there)]."""
    streams: dict[int, list[tuple[bytes, int | None]]] = {}
    parts: dict[int, bytearray] = {}
    numbers: dict[int, int] = {}
    ended: set[int] = set()
    at = 0
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise OggError("a page is cut off")
        magic, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = media[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        if len(lacing) < n or at + size > len(media):
            raise OggError("a page is cut off")
        raw = media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : at + size]
        if checksum(raw) != crc:
            raise OggError(f"checksum of page {number} of stream {serial:#x}")
        if number != numbers.get(serial, -1) + 1 or serial in ended or bool(flags & 2) != (serial not in streams):
            raise OggError(f"page {number} of stream {serial:#x} is out of order")
        numbers[serial] = number
        packets, part = streams.setdefault(serial, []), parts.setdefault(serial, bytearray())
        if bool(flags & 1) != (serial in parts and bool(part)):
            raise OggError("a continued packet lacks a part")
        body, before = at + 27 + n, len(packets)
        full = 0
        for v in lacing:
            full += v
            if v < 255:
                part += media[body : body + full]
                body, full = body + full, 0
                packets.append((bytes(part), None))
                part.clear()
        part += media[body : body + full]
        if len(packets) > before:
            packets[-1] = (packets[-1][0], granule)
        if flags & 4:
            if part:
                raise OggError("the last packet isn't whole")
            ended.add(serial)
        at += size
    if ended != set(streams):
        raise OggError("a stream has no end")
    return streams


def read_payload(media: bytes) -> tuple[bytes, int, list[tuple[float, bytes]]]:
    """Payload, unpadded size, and (seconds at its end, packet) for each packet that ends a page."""
    streams = decode(media)
    if set(streams) != {SAMPLES, INDEX}:
        raise OggError("the streams aren't those of this writer")
    head, *packets = streams[SAMPLES]
    rate, total = struct.unpack("<IQ", head[0][5:])
    payload = b"".join(p for p, _ in packets)
    n_bytes, again = struct.unpack("<QQ", streams[INDEX][1][0])
    if not len(payload) == total == again or packets[-1][1] != total:
        raise OggError("sizes don't agree")
    return payload, n_bytes, [(g / rate, p) for p, g in packets if g is not None]


def padded(text: str) -> tuple[bytes, int]:
    data = text.encode("utf-8", "replace")
    return data + b"\0" * (-len(data) % 64 if data else 64), len(data)


def features(payload: bytes, marks: list[tuple[float, bytes]]) -> str:
    """Duration, pages with an end, mean and deviation of the samples, sign changes about the middle: fixed digits."""
    x = np.frombuffer(payload, np.uint8)
    mean = int(x.sum(dtype=np.int64)) / len(x)
    square = int(np.dot(counts := np.bincount(x, minlength=256), np.arange(256, dtype=np.int64) ** 2)) / len(x)
    high = x >= 128
    turns = int(np.count_nonzero(high[1:] != high[:-1]))
    share = counts[counts > 0] / len(x)
    return f"s={marks[-1][0]:.4f};pages={len(marks)};mean={mean:.4f};sd={max(0.0, square - mean * mean) ** 0.5:.4f};turns={turns};bits={float(-(share * np.log2(share)).sum()):.4f}"


def media_column(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and media (the whole Ogg medium) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encode(*padded(t)) for t in part.column(1).to_pylist()], pa.binary())], [id_column, "media"])

    out = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), T.StructField("media", T.BinaryType())])
    return texts(df, id_column, text_column).mapInArrow(run, out)


FACTS = [("n_bytes", pa.int64(), T.LongType()), ("payload_bytes", pa.int64(), T.LongType()), ("payload_sha256", pa.string(), T.StringType()), ("tail_crc32", pa.int64(), T.LongType()), ("media_bytes", pa.int64(), T.LongType()), ("media_sha256", pa.string(), T.StringType()), ("feature", pa.string(), T.StringType())]


def media_facts(df: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """What the stored media hold, read back from their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for medium in part.column(1):
                    media = medium.as_py()
                    payload, n, marks = read_payload(media)
                    rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, marks)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, a) for c, (_, a, _) in zip(columns, FACTS, strict=True))], [id_column, *(n for n, _, _ in FACTS)])

    out = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), *(T.StructField(n, t) for n, _, t in FACTS)])
    return df.select(id_column, "media").mapInArrow(run, out)
