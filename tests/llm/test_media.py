import hashlib
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kappaloom.llm import mpeg

DOCS = "doc_id long, text string, media binary, feature string"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_payload_comes_back(payload):
    stream = mpeg.read(data := mpeg.write(payload, "7"))
    assert mpeg.carried(data, stream) == payload
    assert stream.skipped == 0 and stream.crc_bad == 0 and stream.tags["note"] == "7"
    assert stream.table.get("frames", 0) == len(stream.offsets)
    assert stream.samples == 1152 * len(stream.offsets)


def test_resynchronises_behind_garbage_and_between_frames():
    data = mpeg.write(b"x" * 3000)
    whole = mpeg.read(data)
    first = whole.offsets[1]
    broken = b"\xff\xfb\x00junk\xff" + data[:first] + b"\xff\xe0garbage" + data[first:]
    again = mpeg.read(broken)
    assert len(again.offsets) == len(whole.offsets)
    assert again.skipped > 0 and again.samples == whole.samples


def test_finds_a_wrong_checksum_and_a_damaged_payload():
    data = bytearray(mpeg.write(b"y" * 500))
    at = mpeg.read(bytes(data)).offsets[0]
    data[at + 4] ^= 1
    assert mpeg.read(bytes(data)).crc_bad == 1
    data = bytearray(mpeg.write(b"y" * 500))
    data[at + 30] ^= 1
    with pytest.raises(ValueError):
        mpeg.carried(bytes(data), mpeg.read(bytes(data)))


@pytest.mark.parametrize(
    ("word", "size", "samples", "rate"),
    [
        (b"\xff\xfb\x90\x00", 417, 1152, 44100),  # MPEG 1 layer III, 128 kbit/s
        (b"\xff\xfd\x90\x00", 522, 1152, 44100),  # layer II, 160 kbit/s
        (b"\xff\xff\x90\x00", 312, 384, 44100),  # layer I, 288 kbit/s
        (b"\xff\xf3\x80\x00", 208, 576, 22050),  # MPEG 2 layer III, 64 kbit/s
        (b"\xff\xe3\x82\x00", 418, 576, 11025),  # MPEG 2.5 layer III with padding
    ],
)
def test_headers(word, size, samples, rate):
    h = mpeg.header(word)
    assert (h.size, h.samples, h.rate) == (size, samples, rate)


@pytest.mark.parametrize("word", [b"\xff\xe9\x90\x00", b"\xff\xf9\x90\x00", b"\xff\xfb\xf0\x00", b"\xff\xfb\x9c\x00", b"\xff\xfb\x90\x02", b"\x00\xfb\x90\x00", b"\xff"])
def test_no_headers(word):
    assert mpeg.header(word) is None


def test_vbri_and_tags():
    frame = bytearray(b"\xff\xfb\x90\x00" + bytes(413))
    frame[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 900, 2, 2, 3, 2, 1)
    frame[62:66] = struct.pack(">HH", 5, 6)
    plain = b"\xff\xfb\x90\x00" + bytes(413)
    old = b"TAG" + b"A title".ljust(30, b"\0") + bytes(95)
    tag = b"ID3\3\0\0\0\0\0\x14TIT2\0\0\0\x0a\0\0\0Some name"
    ape_item = struct.pack("<II", 2, 0) + b"Year\0" + b"99"
    ape = ape_item + b"APETAGEX" + struct.pack("<IIII", 2000, len(ape_item) + 32, 1, 0) + bytes(8)
    stream = mpeg.read(tag + bytes(frame) + plain * 2 + ape + old)
    assert stream.table == {"kind": "VBRI", "frames": 2, "bytes": 900, "quality": 75, "toc": [15, 18], "frames_a_step": 1, "delay": 0}
    assert stream.tags == {"TIT2": "Some name", "v1.title": "A title", "ape.Year": "99"}
    assert stream.samples == 2304 and stream.seconds == 2304 / 44100


def test_delay_and_padding_are_no_duration():
    plain = b"\xff\xfb\x90\x00" + bytes(413)
    table = bytearray(plain)
    table[36:45] = b"Info" + struct.pack(">IB", 0, 0)
    table[44:68] = b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    stream = mpeg.read(bytes(table) + plain * 3)
    assert (stream.table["encoder"], stream.table["delay"], stream.table["padding"]) == ("LAME3.100", 576, 1000)
    assert stream.samples == 3456 and stream.seconds == (3456 - 1576) / 44100


def bitwise_crc(bits):
    """CRC-16 of a list of bits, one by one."""
    crc = 0xFFFF
    for bit in bits:
        crc = (crc << 1 ^ (0x8005 if crc >> 15 ^ bit else 0)) & 0xFFFF
    return crc


def bits_of(data):
    return [b >> 7 - i & 1 for b in data for i in range(8)]


@pytest.mark.parametrize(
    ("word", "widths", "shared", "channels"),
    [
        (b"\xff\xfc\x80\x00", [4] * 11 + [3] * 12 + [2] * 4, 32, 2),  # 128 kbit/s in stereo, 44.1 kHz: 64 for each
        (b"\xff\xfc\xa0\x40", [4] * 11 + [3] * 12 + [2] * 7, 4, 2),  # 192 kbit/s, joint stereo from subband 4
        (b"\xff\xfc\xa4\x50", [4] * 11 + [3] * 12 + [2] * 4, 8, 2),  # the same at 48 kHz, from subband 8
        (b"\xff\xfc\x10\xc0", [4] * 2 + [3] * 6, 32, 1),  # 32 kbit/s, mono
        (b"\xff\xfc\x18\xc0", [4] * 2 + [3] * 10, 32, 1),  # the same at 32 kHz
        (b"\xff\xf4\x80\x00", [4] * 4 + [3] * 7 + [2] * 19, 32, 2),  # MPEG 2
    ],
)
def test_layer_two_checksums(word, widths, shared, channels):
    rng = random.Random(word)
    size = mpeg.header(word).size
    allocations = [[rng.randrange(1 << w) if rng.random() < 0.7 else 0 for _ in range(channels if band < shared else 1)] for band, w in enumerate(widths)]
    bits = [x >> w - 1 - i & 1 for band, w in zip(allocations, widths, strict=True) for x in band for i in range(w)]
    bits += [rng.randrange(2) for band in allocations for x in band if x for _ in range(2 * (channels // len(band)))]
    body = bits + [rng.randrange(2) for _ in range(8 * (size - 6) - len(bits))]
    frame = word + bitwise_crc(bits_of(word[2:]) + bits).to_bytes(2, "big") + bytes(int("".join(map(str, body[i : i + 8])), 2) for i in range(0, len(body), 8))
    stream = mpeg.read(frame * 2)
    assert (stream.crc_good, stream.crc_bad, len(stream.offsets)) == (2, 0, 2)
    wrong = bytearray(frame)
    wrong[6] ^= 0x10
    assert mpeg.read(bytes(wrong) * 2).crc_bad == 2


def test_free_format():
    frame = b"\xff\xfb\x00\x00" + bytes(600)
    padded = b"\xff\xfb\x02\x00" + bytes(601)
    stream = mpeg.read(b"junk" + frame * 3 + padded + frame * 2)
    assert stream.offsets == [4, 608, 1212, 1816, 2421, 3025] and stream.skipped == 4 and stream.samples == 6 * 1152


FRAGMENTS = st.lists(
    st.one_of(st.binary(max_size=40), st.sampled_from([b"\xff\xfb\x90\x00", b"\xff\xfb\x10\x00", b"\xff\xfa\x14\xc0", b"\xff\xfd\x10\x00", b"\xff\xfe\x10\x00", b"\xff\xfb\x00\x00", b"VBRI", b"Xing\0\0\0\x0f", b"Info", b"LAME", b"ID3\3\0\0\0\0\0\x14TIT2", b"APETAGEX", b"TAG", bytes(32), bytes(100), bytes(413)])),
    max_size=14,
).map(b"".join)


@settings(max_examples=500, deadline=None)
@given(FRAGMENTS, st.sampled_from([b"", b"TAG" + bytes(125), b"APETAGEX" + bytes(24), b"\xff\xfb\x10\x00" + bytes(32) + b"VBRI"]))
def test_any_bytes_are_read(data, tail):
    stream = mpeg.read(data + tail)
    assert len(stream.offsets) == len(stream.headers) and stream.samples == sum(h.samples for h in stream.headers)
    assert all(b >= a + h.size for a, b, h in zip(stream.offsets, stream.offsets[1:], stream.headers, strict=False))
    assert mpeg.feature(stream)


def test_documents(spark):
    texts = [None, "", "é" * 96, "word " * 60000, "same", "same"]
    rows = [(i, t, b"clash", "clash") for i, t in enumerate(texts)] + [(None, "no id", None, None)]
    found = mpeg.media_features(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = by_id[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert len(r.seek_offsets) * 1152 == r.samples and r.sample_rate == 48000
    assert by_id[4][1:] == by_id[5][1:]
    assert by_id[None].n_bytes == 5
    assert mpeg.media_features(spark.createDataFrame([], DOCS)).count() == 0


def test_media_that_are_not_ours(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray(b"text")), (3, bytearray(b"\xff\xfb\x90\x00" + bytes(413)))], "id long, media binary")
    found = {r.id: r for r in mpeg.inspect(rows).collect()}
    assert found[1].media_bytes is None and found[2].payload_bytes is None
    assert found[2].feature == "none;skipped=4" and found[3].samples == 1152
