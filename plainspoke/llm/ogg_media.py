"""Media columns: 8-bit samples in Ogg containers, written and read without loss.

Writing cuts a payload into packets of ``PACKET`` samples, deals them in turn to
``STREAMS`` logical streams, laces each stream's packets into pages of at most
``SEGMENTS`` segments (so packets run over pages) and multiplexes the pages by
the time they end at. Reading verifies each page's checksum and number,
reassembles packets from the lacing values, demultiplexes the streams by serial
number, derives each packet's time from granule positions, and joins the packets
in their original order.

The checksum of an Ogg page is a CRC-32 with the common polynomial, unreflected
and without inversions; it is computed with zlib's reflected one over bytes whose
bits are reversed.

Defined results: null and empty texts are stored as padding alone; equal texts
have equal media. Damaged media raise ``BadMedia`` in ``read`` and are null in
the column form. Memory is a few times one text, however long. Repeated rows give
repeated results, an empty table none; no column but the text is read, whatever the
others are called.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UNIT, PACKET, STREAMS, SEGMENTS, RATE = 192, 192 * 16, 2, 40, 8000
_MAGIC = b"\x80pcm8\0\0\0"
_HEAD = struct.Struct("<4sBBqIIIB")
_IDENT = struct.Struct("<8sIBBQ")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_CONTINUED, _FIRST, _LAST = 1, 2, 4


class BadMedia(ValueError):
    """Bytes that aren't what ``store`` writes."""


class Media(NamedTuple):
    payload: bytes
    #: (serial number, packets, samples, seconds) of each stream, and each packet's end in seconds, in order of the payload.
    streams: list[tuple[int, int, int, float]]
    times: list[float]
    pages: int


def checksum(page: bytes) -> int:
    """The CRC of a page whose checksum field is zero."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def payload_of(text: str | None) -> bytes:
    """UTF-8 with spaces up to a positive multiple of ``UNIT``."""
    raw = (text or "").encode("utf-8", "replace")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = bytearray(_HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body)
    page[22:26] = checksum(bytes(page)).to_bytes(4, "little")
    return bytes(page)


def store(payload: bytes) -> bytes:
    """An Ogg file of the payload's bytes as unsigned 8-bit samples."""
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    pages: list[tuple[int, int, int, bytes]] = []
    for s in range(STREAMS):
        ident = _IDENT.pack(_MAGIC, RATE, 8, s, len(payload))
        own = packets[s::STREAMS]
        pages.append((-1, s, 0, _page(_FIRST | (0 if own else _LAST), 0, s + 1, 0, bytes([len(ident)]), ident)))
        lacing, body, done, samples = bytearray(), b"".join(own), [], 0
        for p in own:
            lacing += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
            samples += len(p)
            done.append((len(lacing), samples))
        at = used = end = k = number = 0
        while at < len(lacing):
            part = bytes(lacing[at : at + SEGMENTS])
            granule, flags, size = -1, (_CONTINUED if at and lacing[at - 1] == 255 else 0), sum(part)
            at += len(part)
            while k < len(done) and done[k][0] <= at:
                granule = end = done[k][1]
                k += 1
            flags |= _LAST if at == len(lacing) else 0
            number += 1
            pages.append((end, s, number, _page(flags, granule, s + 1, number, part, body[used : used + size])))
            used += size
    return b"".join(p[3] for p in sorted(pages, key=lambda p: p[:3]))


def read(media: bytes) -> Media:
    """The payload and the times of what ``store`` wrote; BadMedia if anything is amiss."""
    at, pages = 0, 0
    numbers: dict[int, int] = {}
    idents: dict[int, tuple] = {}
    packets: dict[int, list[bytes]] = {}
    ends: dict[int, list[int]] = {}
    begun: dict[int, list[bytes]] = {}
    over: set[int] = set()
    while at < len(media):
        if len(media) - at < _HEAD.size:
            raise BadMedia("a page is cut short")
        mark, version, flags, granule, serial, number, crc, segments = _HEAD.unpack_from(media, at)
        if mark != b"OggS" or version:
            raise BadMedia("no page where one should begin")
        lacing = media[at + _HEAD.size : at + _HEAD.size + segments]
        start, size = at + _HEAD.size + segments, sum(lacing)
        page = media[at : start + size]
        if len(lacing) != segments or len(page) != _HEAD.size + segments + size:
            raise BadMedia("a page is cut short")
        if checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise BadMedia("a page's checksum is wrong")
        if number != numbers.get(serial, -1) + 1 or serial in over or bool(flags & _FIRST) != (number == 0):
            raise BadMedia("a page is missing or repeated")
        if bool(flags & _CONTINUED) != bool(begun.get(serial)):
            raise BadMedia("a packet lacks a part")
        numbers[serial], at, pages = number, start + size, pages + 1
        held, whole, where = begun.setdefault(serial, []), [], start
        run = 0
        for x in lacing:
            run += x
            if x < 255:
                held.append(media[where : where + run])
                whole.append(b"".join(held))
                held.clear()
                where, run = where + run, 0
        if run or lacing.endswith(b"\xff"):
            held.append(media[where : where + run])
        if number == 0:
            if len(whole) != 1 or len(whole[0]) != _IDENT.size or whole[0][:8] != _MAGIC:
                raise BadMedia("a stream isn't of 8-bit samples")
            idents[serial] = _IDENT.unpack(whole[0])
        else:
            packets.setdefault(serial, []).extend(whole)
            # the granule position is the end of the last packet that ends here; earlier ones end before it
            if bool(whole) != (granule >= 0):
                raise BadMedia("a granule position is wrong")
            end = granule
            back = []
            for p in reversed(whole):
                back.append(end)
                end -= len(p)
            ends.setdefault(serial, []).extend(reversed(back))
        if flags & _LAST:
            over.add(serial)
    if not idents or over != set(idents) or any(begun.values()):
        raise BadMedia("a stream has no end")
    order = sorted(idents, key=lambda k: idents[k][3])
    rate, total = idents[order[0]][1], idents[order[0]][4]
    for k in order:
        sizes = np.cumsum([len(p) for p in packets.get(k, [])]).tolist()
        if sizes != ends.get(k, []):
            raise BadMedia("a granule position is wrong")
    n = max((len(packets.get(k, [])) for k in order), default=0)
    lists = [(packets.get(k, []), ends.get(k, [])) for k in order]
    joined = [(p[i], e[i] / rate) for i in range(n) for p, e in lists if i < len(p)]
    payload = b"".join(p for p, _ in joined)
    if len(payload) != total:
        raise BadMedia("samples are missing")
    return Media(payload, [(k, len(p), e[-1] if e else 0, (e[-1] if e else 0) / rate) for k, (p, e) in zip(order, lists, strict=True)], [t for _, t in joined], pages)


def feature(media: Media) -> str:
    """Streams, pages, packets, seconds, and the samples' mean and root mean square."""
    x = np.frombuffer(media.payload, np.uint8).astype(np.int64)
    return f"streams={len(media.streams)};pages={media.pages};packets={len(media.times)};seconds={max(media.times, default=0):.6f};mean={x.sum() / max(1, len(x)):.4f};rms={np.sqrt((x * x).sum() / max(1, len(x))):.4f}"


def stored(text: Column) -> Column:
    """Binary column of the Ogg files of a text column."""

    @F.pandas_udf("binary")
    def write(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([store(payload_of(t if isinstance(t, str) else None)) for t in texts], dtype=object)

    return write(text)


def probed(media: Column) -> Column:
    """Struct of digests and features of a binary column of Ogg files; null where the media are null or damaged."""
    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [part.split()[0] for part in schema.split(", ")]

    @F.pandas_udf(schema)
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in batches:
            rows = []
            for raw in some:
                try:
                    got = read(bytes(raw)) if raw is not None else None
                except BadMedia:
                    got = None
                rows.append((len(got.payload), hashlib.sha256(got.payload).hexdigest(), zlib.crc32(got.payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(got)) if got else (None,) * 6)
            yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64", "tail_crc32": "Int64", "media_bytes": "Int64"})

    return look(media)


def op10_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select("doc_id", n_bytes, probed(stored(F.col("text"))).alias("_m")).select("doc_id", "n_bytes", "_m.*")
