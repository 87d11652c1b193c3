"""Media columns: documents as sound in Ogg containers, written and read back.

A payload becomes unsigned 8-bit mono samples in the OggPCM mapping; a second logical stream, interleaved with it,
carries one text note for every few packets. Packets of samples run on over page borders. The reader checks every page's checksum and sequence number,
reassembles packets from lacing values over page borders, separates the logical streams by serial number, and derives
times from granule positions: a page gives that of the last packet that ends on it, lengths of packets give the others,
and every page's must agree with them.

Cases: a null or empty text is 64 zero samples; texts of any length are stored whole; equal texts give equal files;
an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame

from .common import map_batches, texts_of

#: Fixed values of the Ogg page format: capture pattern, header, most lacing values on a page, header flags.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
MAX_SEGMENTS = 255
CONTINUED, FIRST, LAST = 1, 2, 4
#: Fixed values of the OggPCM mapping: header packet, number of the format "unsigned 8-bit".
PCM_HEADER = struct.Struct(">8sHHIIBBHI")
PCM_MAGIC, PCM_U8 = b"PCM     ", 1

SAMPLE_RATE = 8000
PACKET_SAMPLES = 4096
NOTE_PACKETS = 12
UNIT = 64
PCM_SERIAL, NOTE_SERIAL = 1, 2

#: Ogg's checksum takes bits from the other end than zlib's: bytes and result are mirrored.
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """The page checksum (polynomial 04c11db7, start 0, no final inversion) of a page whose checksum field is zero."""
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = lambda crc: HEADER.pack(CAPTURE, 0, flags, granule, serial, number, crc, len(lacing)) + lacing
    return head(page_crc(head(0) + body)) + body


def pages_of(serial: int, groups: list[list[tuple[bytes, int]]]) -> list[bytes]:
    """The pages of one logical stream. Each group of (packet, granule position at its end) begins a new page."""
    out: list[tuple[int, int, bytes, bytes]] = []
    for group in groups:
        lacing, body, granule, flags = bytearray(), bytearray(), -1, 0
        for packet, end in group:
            values = bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255])
            at = 0
            while values:
                room = MAX_SEGMENTS - len(lacing)
                if not room:
                    out.append((granule, flags, bytes(lacing), bytes(body)))
                    flags = CONTINUED if at else 0
                    lacing, body, granule = bytearray(), bytearray(), -1
                    continue
                part, values = values[:room], values[room:]
                size = sum(part)
                lacing += part
                body += packet[at : at + size]
                at += size
                if not values:
                    granule = end
        out.append((granule, flags, bytes(lacing), bytes(body)))
    last = len(out) - 1
    return [_page(serial, i, g, f | FIRST * (i == 0) | LAST * (i == last), s, b) for i, (g, f, s, b) in enumerate(out)]


def write_ogg(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """``payload`` as a physical Ogg stream of two multiplexed logical streams."""
    head = PCM_HEADER.pack(PCM_MAGIC, 0, 0, PCM_U8, rate, 8, 1, PACKET_SAMPLES, 0)
    blocks = [payload[i : i + PACKET_SAMPLES] for i in range(0, len(payload), PACKET_SAMPLES)]
    ends = [min(len(payload), (i + 1) * PACKET_SAMPLES) for i in range(len(blocks))]
    timed = list(zip(blocks, ends, strict=True))
    noted = [timed[i : i + NOTE_PACKETS] for i in range(0, len(timed), NOTE_PACKETS)]
    notes = [[(b"NOTE\0" + str(rate).encode(), 0)]] + [[(b"samples %d crc %08x" % (group[-1][1], zlib.crc32(b"".join(x for x, _ in group))), group[-1][1])] for group in noted]
    a, b = pages_of(PCM_SERIAL, [[(head, 0)], timed]), pages_of(NOTE_SERIAL, notes)
    out, rest = [a[0], b[0]], b[1:]
    for k, page in enumerate(a[1:]):
        out.append(page)
        out += rest[k : k + 1]
    return b"".join([*out, *rest[len(a) - 1 :]])


class OggError(ValueError):
    """A damaged container."""


@dataclass
class LogicalStream:
    """Packets of a logical stream, each with its end position (None where the page's belongs to a later packet)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    _part: bytes | None = None

    def ends(self, lengths: list[int]) -> list[int]:
        """The position at which each packet ends, from the pages' positions and the packets' lengths. Raises OggError where they disagree."""
        ends = list(accumulate(lengths))
        known = [(g, e) for g, e in zip(self.granules, ends, strict=True) if g is not None]
        shift = known[0][0] - known[0][1] if known else 0
        if any(g - e != shift for g, e in known):
            raise OggError(f"granule positions of stream {self.serial} disagree with its packets")
        return [e + shift for e in ends]

    def seconds(self, lengths: list[int], rate: int) -> list[float]:
        """The time at which each packet ends."""
        return [e / rate for e in self.ends(lengths)]


def read_ogg(data: bytes) -> dict[int, LogicalStream]:
    """The logical streams of a physical stream by serial number. Raises OggError for damage."""
    streams: dict[int, LogicalStream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise OggError(f"cut page header at {at}")
        magic, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        if magic != CAPTURE or version:
            raise OggError(f"no page at {at}")
        begin = at + HEADER.size + n
        lacing = data[at + HEADER.size : begin]
        end = begin + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError(f"cut page at {at}")
        if page_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at {at}")
        if flags & FIRST:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial] = LogicalStream(serial)
        if serial not in streams or streams[serial].ended:
            raise OggError(f"page outside of stream {serial}")
        s = streams[serial]
        if number != s.pages or bool(flags & CONTINUED) != (s._part is not None):
            raise OggError(f"missing page in stream {serial}")
        s.pages += 1
        complete = len(s.packets)
        part = s._part or b""
        place, cut, open_ = begin, begin, s._part is not None
        for value in lacing:
            place += value
            open_ = True
            if value < 255:
                s.packets.append(part + data[cut:place])
                s.granules.append(None)
                part, cut, open_ = b"", place, False
        s._part = part + data[cut:place] if open_ else None
        if len(s.packets) > complete:
            s.granules[-1] = granule
        s.ended = bool(flags & LAST)
        at = end
    for s in streams.values():
        if not s.ended or s._part is not None:
            raise OggError(f"stream {s.serial} has no end")
    return streams


def payload_of(text: bytes) -> bytes:
    """The bytes padded by zeros up to a positive multiple of 64."""
    return text + bytes(max(UNIT, -len(text) % UNIT + len(text)) - len(text))


def read_payload(data: bytes) -> tuple[bytes, str]:
    """The samples of a container and its features as text: samples, rate, seconds, packets, pages, notes, mean, peak."""
    streams = read_ogg(data)
    sound = next((s for s in streams.values() if s.packets[0].startswith(PCM_MAGIC)), None)
    if sound is None:
        raise OggError("no sound")
    _, _, _, kind, rate, bits, channels, _, _ = PCM_HEADER.unpack(sound.packets[0])
    if (kind, bits, channels) != (PCM_U8, 8, 1):
        raise OggError("other samples than unsigned 8-bit mono")
    samples = b"".join(sound.packets[1:])
    times = sound.seconds([0, *map(len, sound.packets[1:])], rate)
    if sound.granules[0] != 0 or sound.granules[-1] != len(samples):
        raise OggError("granule positions differ from the number of samples")
    notes = sum(len(s.packets) - 1 for s in streams.values() if s is not sound)
    last = times[-1]
    used = set(samples)
    feature = f"samples={len(samples)};rate={rate};seconds={last:.6f};packets={len(sound.packets) - 1};pages={sound.pages};streams={len(streams)};notes={notes};low={min(used)};high={max(used)}"
    return samples, feature


def media_digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Stores each text as an Ogg container, reads it back and describes both."""
    schema = f"{key} {dict(docs.dtypes)[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batch):
        out = {name: [] for name in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for x in texts_of(batch, text):
            raw = x.encode("utf-8", "surrogatepass")
            media = write_ogg(payload_of(raw))
            back, feature = read_payload(media)
            values = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature)
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        return {key: batch.column(key), **out}

    return map_batches(docs.select(key, text), run, schema)
