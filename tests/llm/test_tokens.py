import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

from kappaloom.llm import bpe, rans

DOCS = "doc_id long, text string, ids string, n_tokens string"
BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PIECES = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\x1c", "\xa0", "a", "The", "'s", "'Re", "12", "!?", "é", "é", "Σ", "İ", "漢", "🙂", "<|endoftext|>", "<|startoftext|>", "aaaa", "​"]), max_size=12).map("".join)
TEXTS = st.one_of(PIECES, st.text(max_size=20))


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE), rans.UnitTokens(BYTE, "<u2")


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD), bpe.Encoder(bpe.Merges.load(WORD), cache_pieces=50)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_units_equal_the_library(byte, texts):
    library, units = byte
    found = [x.as_py() for part in units.encode(pa.array([*texts, None], pa.string()), 2) for x in part]
    assert found.pop() == b"\2\0" and len(found) == len(texts)
    for text, packed in zip(texts, found, strict=True):
        assert np.frombuffer(packed, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids + [2]


def test_a_full_cache_and_small_batches_change_nothing(monkeypatch):
    rng = random.Random(7)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(50)]
    whole = [x.as_py() for part in rans.UnitTokens(BYTE, "<u2").encode(pa.array(texts), 2) for x in part]
    monkeypatch.setattr(rans, "BATCH_BYTES", 90)
    units = rans.UnitTokens(BYTE, "<u2", cache_units=20)
    assert [x.as_py() for part in units.encode(pa.array(texts), 2) for x in part] == whole
    assert len(units.units) == units.known == 20


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_merge_rounds_equal_the_library(word, texts):
    library, encoder = word
    for text, (n, ids, decoded) in zip(texts, encoder.batches(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(expected), " ".join(map(str, expected)))
        assert decoded == library.decode(expected, skip_special_tokens=False)


def test_a_table_that_rounds_cannot_follow_is_refused(tmp_path):
    bad = tmp_path / "bad.json"
    bad.write_text('{"added_tokens": [], "model": {"vocab": {"a": 0, "b": 1, "ab": 2, "abb": 3}, "merges": [["ab", "b"], ["a", "b"]]}}')
    with pytest.raises(ValueError):
        bpe.Merges.load(str(bad))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=400), st.integers(1, 64))
def test_blocks_round_trip(ids, lanes):
    ids = np.array(ids, np.uint32)
    coder = rans.Coder(rans.scaled(np.bincount(ids, minlength=31), 12), 12, lanes)
    assert (coder.decode(coder.encode(ids), len(ids)) == ids).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=50))
def test_scaled(counts):
    out = rans.scaled(np.array(counts), 8)
    assert out.sum() == (256 if sum(counts) else 0)
    assert all((a > 0) == (c > 0) for a, c in zip(out.tolist(), counts, strict=True))


def _rows():
    texts = [None, "", "plain text", "two  spaces\n\n and <|endoftext|>", "long word " * 30000, "x" * 3000, "same", "same"]
    return [(9 - i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "no id", None, None), (3, "same", None, None)]


def test_token_files(spark):
    library, rows = Tokenizer.from_file(BYTE), _rows()
    found = rans.token_table(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(found) == len(rows)
    expected = {}
    for doc_id, text, _, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        expected.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = {}
    start = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert rans.token_table(spark.createDataFrame([], DOCS)).count() == 0


def test_small_blocks_and_damage(tmp_path):
    ids = [np.arange(i, dtype="<u2") % 7 for i in (0, 5, 300, 0, 40)]
    coder = rans.Coder(rans.scaled(np.ones(7, np.int64), 6), 6, 4)
    url = f"file://{tmp_path}/x.tok"
    file = rans.TokenFileWriter(url, coder, block=64)
    for i, x in enumerate(ids):
        file.add(None if i == 3 else i, x)
    file.close()
    read = rans.TokenFile(url)
    assert [d for d, _ in read.documents()] == [0, 1, 2, None, 4]
    assert all((a == b).all() for (_, a), b in zip(read.documents(), ids, strict=True))
    assert len(read.checkpoints) == 6 and (read.block(3) == np.concatenate(ids)[192:256]).all()
    path = fs.FileSystem.from_uri(url)[1]
    data = bytearray(open(path, "rb").read())
    data[int(read.checkpoints[2][2]) + 9] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match="block 2"):
        rans.TokenFile(url).block(2)


def test_encoded_documents(spark):
    library, rows = Tokenizer.from_file(WORD), _rows()
    found = bpe.encode_documents(spark.createDataFrame(rows, DOCS)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for doc_id, text, _, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    arrays = bpe.encode_documents(spark.createDataFrame(rows[2:3], DOCS), outputs=("ids", "decoded")).first()
    assert arrays.ids == library.encode("plain text", add_special_tokens=False).ids
    assert bpe.encode_documents(spark.createDataFrame([], DOCS)).count() == 0
