"""MPEG audio streams: writing payload-carrying ones, and reading any.

Reading resynchronises on frame headers, parses ID3v1, ID3v2 and APE tags and the
Xing, Info and VBRI tables of variable-bitrate streams, verifies the CRC-16 of
protected frames of all layers, and yields the exact number of samples, less the encoder's delay and padding where the
table tells them, and the offset of every frame. The frame size of free-format streams is that to the next
frame of the same kind.

A payload is carried in the frames' ancillary bytes: Layer III frames of 48 kHz
with empty granules have, behind header, checksum and side information, only
bytes that decoders skip. A comment in the ID3v2 tag has the payload's lengths and CRC-32.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged

UNIT = 192
# Fixed values of the format: kbit/s by bitrate index 1 to 14, and samples a second, by version and layer.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ (0x8005 if crc & 0x8000 else 0)) & 0xFFFF
        out.append(crc)
    return out


CRC_TABLE = _crc_table()


@lru_cache(1 << 14)
def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ CRC_TABLE[crc >> 8 ^ byte]
    return crc


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    size: int
    samples: int
    side: int
    mode: int
    extension: int


@lru_cache(1 << 12)
def header(word: bytes) -> Header | None:
    """What the four bytes of a frame header say; None if they are none. A free-format frame has no bitrate, and padding as its size."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    index, rate_index = word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or index == 15 or rate_index == 3 or word[3] & 3 == 2:
        return None
    first = version == 3
    kbps, rate = BITRATES[1 if first else 2, layer][index - 1] if index else 0, RATES[version][rate_index]
    padding, mode = word[2] >> 1 & 1, word[3] >> 6
    mono = mode == 3
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12000 * kbps // rate + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + padding
    side = 0 if layer < 3 else (17 if mono else 32) if first else 9 if mono else 17
    return Header(version, layer, not word[1] & 1, kbps, rate, 1 if mono else 2, size, samples, side, mode, word[3] >> 4 & 3)


@dataclass
class Stream:
    """What a stream holds. offsets: of every audio frame, the table's frame left out."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    samples: int = 0
    trimmed: int = 0
    rate: int = 0
    channels: int = 0
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0

    @property
    def seconds(self) -> float:
        """The exact duration: without the encoder's delay and padding."""
        return max(0, self.samples - self.trimmed) / self.rate if self.rate else 0.0


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(data: bytes) -> str:
    kinds = ("latin-1", "utf-16", "utf-16-be", "utf-8")
    return data[1:].decode(kinds[data[0]] if data[0] < 4 else "latin-1", "replace") if data else ""


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Parse the tag at `at`; where it ends, `at` if there is none."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(b & 0x80 for b in data[at + 6 : at + 10]):
        return at
    major, flags = data[at + 3], data[at + 5]
    end = at + 10 + _syncsafe(data[at + 6 : at + 10])
    i, head = at + 10, 6 if major == 2 else 10
    if flags & 0x40 and major > 2 and len(data) >= i + 4:
        i += _syncsafe(data[i : i + 4]) if major == 4 else 4 + int.from_bytes(data[i : i + 4], "big")
    while i + head <= min(end, len(data)) and data[i]:
        if major == 2:
            name, n = data[i : i + 3], int.from_bytes(data[i + 3 : i + 6], "big")
        else:
            raw = data[i + 4 : i + 8]
            name, n = data[i : i + 4], _syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        body = data[i + head : min(end, i + head + n)]
        key = name.decode("latin-1")
        if key.startswith("T"):
            value = _text(body)
            if key in ("TXXX", "TXX"):
                key, _, value = value.partition("\0")
            tags.setdefault(key, value.rstrip("\0"))
        i += head + n
    return end + (10 if flags & 0x10 else 0)


def _trailing_tags(data: bytes, tags: dict[str, str]) -> int:
    """Parse an ID3v1 tag and an APE tag at the end; where they begin."""
    end = len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end - 128 + a : end - 128 + b].rstrip(b"\0 ").decode("latin-1"):
                tags.setdefault(f"v1.{key}", value)
        end -= 128
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, count, flags = struct.unpack_from("<III", data, end - 20)
        i = end - size
        for _ in range(count if 0 <= i else 0):
            if i + 8 > end - 32:
                break
            n = struct.unpack_from("<I", data, i)[0]
            stop = data.find(b"\0", i + 8, end)
            if stop < 0:
                break
            tags.setdefault("ape." + data[i + 8 : stop].decode("latin-1"), data[stop + 1 : stop + 1 + n].decode("utf-8", "replace"))
            i = stop + 1 + n
        end -= min(end, size + (32 if flags & 0x80000000 else 0))
    return end


def _table(data: bytes, at: int, h: Header) -> dict[str, object]:
    """The Xing, Info or VBRI table in the frame at `at`; empty if it has none."""
    for start in (at + 4 + h.side, at + 6 + h.side) if h.layer == 3 else ():
        if data[start : start + 4] in (b"Xing", b"Info") and start + 8 <= at + h.size:
            flags, i = int.from_bytes(data[start + 4 : start + 8], "big"), start + 8
            out: dict[str, object] = {"kind": data[start : start + 4].decode()}
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[key] = int.from_bytes(data[i : i + 4], "big")
                    i += 4
            if flags & 4:
                out["toc"] = list(data[i : i + 100])
                i += 100
            if flags & 8:
                out["quality"] = int.from_bytes(data[i : i + 4], "big")
                i += 4
            # the encoder's name, and behind it, twelve bits each, the samples that it put before and behind the sound
            if i + 24 <= at + h.size and data[i : i + 4].isalnum():
                out["encoder"] = data[i : i + 9].decode("latin-1").rstrip("\0 ")
                both = int.from_bytes(data[i + 21 : i + 24], "big")
                out["delay"], out["padding"] = both >> 12, both & 0xFFF
            return out
    if data[at + 36 : at + 40] == b"VBRI" and h.layer == 3 and at + 62 <= at + h.size <= len(data):
        _, delay, quality, size, frames, entries, scale, width, step = struct.unpack_from(">HHHIIHHHH", data, at + 40)
        # no more entries than the frame has bytes for
        part = data[at + 62 : at + h.size]
        toc = [scale * int.from_bytes(part[width * k : width * (k + 1)], "big") for k in range(min(entries, len(part) // width if width else 0))]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "quality": quality, "toc": toc, "frames_a_step": step, "delay": delay}
    return {}


def _same(a: Header, b: Header | None) -> bool:
    return b is not None and (a.version, a.layer, a.rate, a.kbps == 0) == (b.version, b.layer, b.rate, b.kbps == 0)


#: Bytes within which the next free-format frame must begin.
FREE = 1 << 13


def _free_size(data: bytes, at: int, end: int, h: Header) -> int:
    """The bytes of a free-format stream's frames without padding: as far as the next frame of its kind, if a third, or the end, is as far again; else 0."""
    padding = h.size
    follow = at + 4
    while 0 <= (follow := data.find(b"\xff", follow, min(end, at + FREE))):
        other = header(data[follow : follow + 4])
        if _same(h, other):
            size = follow - at - padding
            third = follow + size + other.size
            if third == end or third + 4 <= end and _same(h, header(data[third : third + 4])):
                return size
        follow += 1
    return 0


def _bits(data: bytes, at: int) -> Callable[[int], int]:
    """A reader of bits, zeros behind the end."""
    place = 8 * at

    def take(n: int) -> int:
        nonlocal place
        part = data[place // 8 : (place + n + 7) // 8].ljust((place + n + 7) // 8 - place // 8, b"\0")
        out = int.from_bytes(part, "big") >> (-(place + n) % 8) & (1 << n) - 1
        place += n
        return out

    return take


def _allocation_bits(h: Header) -> list[int]:
    """Layer II: how many bits each subband's allocation has."""
    each = h.kbps // h.channels
    if h.version != 3:
        widths = ((4, 4), (7, 3), (19, 2))
    elif each >= 56 or not each:
        widths = ((11, 4), (12, 3), (4 if h.rate == 48000 or 56 <= each <= 80 else 7, 2))
    else:
        widths = ((2, 4), (10 if h.rate == 32000 else 6, 3))
    return [w for n, w in widths for _ in range(n)]


def covered_bits(data: bytes, at: int, h: Header) -> int:
    """How many bits behind a frame's checksum it covers."""
    bound = 4 * (h.extension + 1) if h.mode == 1 else 32
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (h.channels * bound + 32 - bound if h.channels == 2 else 32)
    take, bits, filled = _bits(data, at + 6), 0, 0
    for band, width in enumerate(_allocation_bits(h)):
        # subbands of joint stereo share one allocation; each channel of a filled one has two bits of choice
        for _ in range(h.channels if band < bound else 1):
            bits += width
            if take(width):
                filled += 1 if band < bound else h.channels
    return bits + 2 * filled


def checksum(data: bytes, at: int, h: Header) -> int:
    """The CRC-16 of a frame's header and of the bits behind the checksum that it covers."""
    whole, rest = divmod(covered_bits(data, at, h), 8)
    crc = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + whole])
    last = data[at + 6 + whole] if rest and at + 6 + whole < len(data) else 0
    for i in range(rest):
        crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ last >> 7 - i) & 1 else 0)) & 0xFFFF
    return crc


def read(data: bytes | None) -> Stream:
    """Parse a stream. Bytes between frames, and a last frame that is cut, are skipped and counted.

    >>> read(None).seconds, read(b"no audio").skipped
    (0.0, 8)
    """
    out, data = Stream(), data or b""
    end = _trailing_tags(data, out.tags)
    at, locked, free = 0, None, 0
    while (after := _id3v2(data, at, out.tags)) > at:
        at = after
    while at < end:
        h = header(data[at : at + 4])
        if h is not None and not h.kbps:
            free = free or _free_size(data, at, end, h)
            h = replace(h, size=h.size + free) if free else None
        fits = h is not None and at + h.size <= end
        if fits and not (locked and _same(locked, h)):
            # a first frame, or one behind a gap, needs a second frame behind it, or the end
            fits = at + h.size >= end or _same(h, header(data[at + h.size : at + h.size + 4]))
        if not fits:
            follow = data.find(b"\xff", at + 1, end)
            step = (follow if follow >= 0 else end) - at
            out.skipped += step
            at += step
            locked, free = None, 0
            continue
        assert h is not None
        if h.protected:
            good = checksum(data, at, h) == int.from_bytes(data[at + 4 : at + 6], "big")
            out.crc_good += good
            out.crc_bad += not good
        table = {} if out.offsets or out.table else _table(data, at, h)
        if table:
            out.table, out.trimmed = table, int(table.get("delay", 0)) + int(table.get("padding", 0))
        else:
            out.offsets.append(at)
            out.headers.append(h)
            out.samples += h.samples
        out.rate, out.channels, locked = h.rate, h.channels, h
        at += h.size
    return out


def _frame(kbps_index: int, body: bytes) -> bytes:
    """A protected mono Layer III frame of 48 kHz with empty granules and `body` behind them."""
    head = bytes((0xFF, 0xFA, kbps_index << 4 | 1 << 2, 0xC0))
    side = bytes(17)
    room = 3 * BITRATES[1, 3][kbps_index - 1] - 23
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side + body + bytes(room - len(body))


def write(payload: bytes, note: str = "") -> bytes:
    """A stream that carries the payload: tags, a Xing table, frames of 320 kbit/s and a last one as small as fits."""
    rooms = [3 * k - 23 for k in BITRATES[1, 3]]
    most = rooms[-1]
    frames = [_frame(14, payload[i : i + most]) for i in range(0, len(payload) // most * most, most)]
    if rest := payload[len(frames) * most :]:
        frames.append(_frame(1 + next(i for i, r in enumerate(rooms) if r >= len(rest)), rest))
    total = sum(map(len, frames))
    bounds = [0]
    for f in frames:
        bounds.append(bounds[-1] + len(f))
    toc = bytes(min(255, 256 * bounds[len(frames) * i // 100] // max(1, total)) for i in range(100))
    # without delay and padding, as every frame is whole
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc + b"kappaloom" + bytes(15)
    notes = {"payload": f"{len(payload)} {zlib.crc32(payload)}", "note": note}
    tag = b""
    for key, value in notes.items():
        body = b"\3" + key.encode() + b"\0" + value.encode()
        n = len(body)
        tag += b"TXXX" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + bytes(2) + body
    n = len(tag)
    head = b"ID3\4\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    return head + tag + _frame(5, xing) + b"".join(frames) + b"TAG" + bytes(124) + b"\xff"


def carried(data: bytes, stream: Stream) -> bytes:
    """The payload of a stream that `write` made, verified."""
    length, crc = map(int, stream.tags["payload"].split())
    parts = [data[at + 23 : at + h.size] for at, h in zip(stream.offsets, stream.headers, strict=True)]
    payload = b"".join(parts)[:length]
    if len(payload) != length or zlib.crc32(payload) != crc:
        raise ValueError("the payload is damaged")
    return payload


def feature(stream: Stream) -> str:
    """One line: layer, rate, channels, samples, seconds, frames, mean kbit/s (by size and duration), checksums, skipped bytes, table."""
    if not stream.headers:
        return f"none;skipped={stream.skipped}"
    h, kbps = stream.headers[0], sum(x.size for x in stream.headers) * 8 * stream.rate / stream.samples / 1000
    version = {3: "1", 2: "2", 0: "2.5"}[h.version]
    return (
        f"mpeg{version}-layer{h.layer};rate={stream.rate};channels={stream.channels};samples={stream.samples};seconds={stream.seconds:.6f};frames={len(stream.headers)}"
        f";kbps={kbps:.3f};crc={stream.crc_good}/{stream.crc_good + stream.crc_bad};skipped={stream.skipped};table={stream.table.get('kind', 'none')}:{stream.table.get('frames', 0)}"
    )


def payload_of(text: str | None) -> tuple[int, bytes]:
    """A text's UTF-8 bytes filled up with spaces to a positive multiple of UNIT; the number without them comes first."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


def store(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, media): every text as an MPEG stream. Null texts are empty; other columns are left out."""

    @F.pandas_udf("binary")
    def media(texts: pd.Series) -> pd.Series:
        return pd.Series([write(payload, str(n)) for n, payload in map(payload_of, texts)], dtype=object)

    return docs.select(F.col(id_column).alias("doc_id"), media(F.col(text_column).cast("string")).alias("media"))


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, sample_rate int, seek_offsets array<long>"


def inspect(stored: DataFrame, media_column: str = "media") -> DataFrame:
    """Replaces the media column by what is read from it: SCHEMA.

    Streams without a payload of ours have nulls in the payload's columns, null
    media nulls everywhere; damaged payloads raise an error.
    """

    def look(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for data in part:
                if data is None:
                    rows.append((None,) * 10)
                    continue
                stream = read(data := bytes(data))
                own: tuple = (None,) * 4
                if "payload" in stream.tags:
                    payload = carried(data, stream)
                    own = (int(stream.tags.get("note") or 0), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
                rows.append((*own, len(data), hashlib.sha256(data).hexdigest(), feature(stream), stream.samples, stream.rate, stream.offsets))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield out.astype({c: "Int64" for c in ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes", "samples", "sample_rate")})

    looked = F.pandas_udf(look, SCHEMA)
    kept = [c for c in stored.columns if c != media_column]
    return stored.select(F.struct(*kept).alias("row"), looked(media_column).alias("seen")).select("row.*", "seen.*")


def media_features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, SCHEMA): store every text as a stream in the shared folder, read the stored bytes back, and describe them.

    A null or empty text is UNIT spaces. Texts of any length are one stream. Repeated rows, ties and null ids come out as they went in; other
    columns, whatever their names, are left out; an empty table gives none.
    """
    return inspect(staged(store(docs, id_column, text_column), "media"))
