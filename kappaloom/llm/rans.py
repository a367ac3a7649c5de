"""Token-id files: a static range asymmetric numeral system over shared frequencies.

All tokens of the corpus are counted once; the counts, scaled to a power of two,
are one table for every block. A block is coded by many interleaved lanes, so one
array operation advances all of them, and holds its own final states: any block
decodes without the others.

A file holds, one after the other: the magic bytes, the blocks, and a footer with
the checkpoints (for each block: first token, tokens, offset, bytes, CRC-32), the
documents in order (id and number of ids), and the frequencies; then the footer's
length and CRC-32. Every attempt of a task writes files of its own names, and only
those of the attempt that succeeded are in the table of files.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, opened, remove, staged, staged_at

MAGIC = b"KLRANS1\n"
#: Frequencies sum to 2**SCALE; states stay in [2**31, 2**63) and move 32 bits at a time.
SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 4096
BLOCK = 1 << 20
#: Tokens in a file, reached or passed by its last document.
FILE_TOKENS = 1 << 24
#: Units that a worker's cache holds, some 200 bytes each; bytes of text encoded at once.
CACHE_UNITS = 1_000_000
BATCH_BYTES = 1 << 23
# Unicode's white space and the four separators, in RE2's syntax.
WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space next to other white space.
BESIDE_SPACE = f"{WHITE} | {WHITE}"


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of sum 2**scale, at least 1 for every token that occurs.

    >>> scaled(np.array([0, 1, 3]), 3).tolist()
    [0, 2, 6]
    """
    counts = np.asarray(counts, np.int64)
    total, whole = int(counts.sum()), 1 << scale
    if not total:
        return counts
    if (counts > 0).sum() > whole:
        raise ValueError("more distinct tokens than the scale has places")
    out = np.maximum((counts.astype(np.float64) * (whole / total)).astype(np.int64), counts > 0)
    off = whole - int(out.sum())
    order = np.argsort(-counts, kind="stable")
    at = 0
    while off:
        i = order[at % len(order)]
        step = max(-int(out[i]) // 2, off) if off < 0 else off
        if off > 0 or out[i] + step >= 1:
            out[i] += step
            off -= step
        at += 1
    return out


class Coder:
    """Codes blocks of token ids with one frequency table."""

    def __init__(self, frequencies: np.ndarray, scale: int = SCALE, lanes: int = LANES) -> None:
        self.frequencies, self.scale, self.lanes = np.asarray(frequencies, np.uint64), scale, lanes
        self.begins = np.r_[np.uint64(0), np.cumsum(self.frequencies)[:-1].astype(np.uint64)]
        self.slots = np.repeat(np.arange(len(self.frequencies), dtype=np.uint32), self.frequencies.astype(np.int64))

    def encode(self, ids: np.ndarray) -> bytes:
        lanes = min(self.lanes, max(1, len(ids) // 16))
        state = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        scale, room = np.uint64(self.scale), np.uint64(63 - self.scale)
        for begin in range((len(ids) - 1) // lanes * lanes if len(ids) else -1, -1, -lanes):
            part = ids[begin : begin + lanes]
            f, c, x = self.frequencies[part], self.begins[part], state[: len(part)]
            full = x >= f << room
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[: len(part)] = (q << scale) + (x - q * f) + c
        return struct.pack("<I", lanes) + state.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))

    def decode(self, data: bytes, n: int) -> np.ndarray:
        lanes = struct.unpack_from("<I", data)[0]
        state = np.frombuffer(data, "<u8", lanes, 4).astype(np.uint64)
        words = np.frombuffer(data, "<u4", -1, 4 + 8 * lanes).astype(np.uint64)
        out, at = np.empty(n, np.uint32), 0
        scale, mask = np.uint64(self.scale), np.uint64((1 << self.scale) - 1)
        for begin in range(0, n, lanes):
            k = min(lanes, n - begin)
            x = state[:k]
            slot = x & mask
            token = self.slots[slot]
            out[begin : begin + k] = token
            x = self.frequencies[token] * (x >> scale) + slot - self.begins[token]
            low = np.flatnonzero(x < LOW)
            x[low] = x[low] << np.uint64(32) | words[at : at + len(low)]
            at += len(low)
            state[:k] = x
        if at != len(words) or (state != LOW).any():
            raise ValueError("a block ends in the wrong state")
        return out


class TokenFileWriter:
    """Takes documents in order and writes one file."""

    def __init__(self, url: str, coder: Coder, block: int = BLOCK) -> None:
        self.fs, self.path = opened(url)
        self.out = self.fs.open_output_stream(self.path)
        self.out.write(MAGIC)
        self.coder, self.block, self.offset, self.tokens = coder, block, len(MAGIC), 0
        self.waiting, self.held = [], 0
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.checkpoints: list[tuple[int, int, int, int, int]] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.sizes.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        while self.held >= self.block:
            joined = np.concatenate(self.waiting)
            self._put(joined[: self.block])
            self.waiting, self.held = [joined[self.block :]], len(joined) - self.block

    def _put(self, ids: np.ndarray) -> None:
        data = self.coder.encode(ids)
        self.out.write(data)
        self.checkpoints.append((self.tokens, len(ids), self.offset, len(data), zlib.crc32(data)))
        self.tokens += len(ids)
        self.offset += len(data)

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.waiting))
        nulls = np.array([d is None for d in self.docs], bool)
        footer = b"".join(
            [
                struct.pack("<QQII", len(self.docs), len(self.checkpoints), self.coder.scale, len(self.coder.frequencies)),
                np.array(self.checkpoints, "<u8").reshape(-1, 5).tobytes(),
                np.packbits(nulls).tobytes(),
                np.array([d or 0 for d in self.docs], "<i8").tobytes(),
                np.array(self.sizes, "<u8").tobytes(),
                self.coder.frequencies.astype("<u4").tobytes(),
            ]
        )
        footer = zlib.compress(footer, 1)
        self.out.write(footer + struct.pack("<QI", len(footer), zlib.crc32(footer)))
        self.out.close()


class TokenFile:
    """Reads a file of TokenFileWriter; every block can be read alone."""

    def __init__(self, url: str, coders: dict | None = None) -> None:
        self.fs, self.path = opened(url)
        self.file = self.fs.open_input_file(self.path)
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{url}: not a token file")
        end = self.file.size()
        length, crc = struct.unpack("<QI", self.file.read_at(12, end - 12))
        packed = self.file.read_at(length, end - 12 - length)
        if zlib.crc32(packed) != crc:
            raise ValueError(f"{url}: the footer is damaged")
        data = zlib.decompress(packed)
        n, blocks, scale, tokens = struct.unpack_from("<QQII", data)
        at = 24
        self.checkpoints = np.frombuffer(data, "<u8", 5 * blocks, at).reshape(-1, 5)
        at += 40 * blocks
        nulls = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n)
        at += (n + 7) // 8
        self.docs = [None if x else d for d, x in zip(np.frombuffer(data, "<i8", n, at).tolist(), nulls, strict=True)]
        at += 8 * n
        self.sizes = np.frombuffer(data, "<u8", n, at).astype(np.int64)
        at += 8 * n
        key = data[at : at + 4 * tokens]
        coders = {} if coders is None else coders
        if key not in coders:
            coders.clear()
            coders[key] = Coder(np.frombuffer(key, "<u4"), scale)
        self.coder = coders[key]

    def block(self, i: int) -> np.ndarray:
        _, n, offset, length, crc = map(int, self.checkpoints[i])
        data = self.file.read_at(length, offset)
        if zlib.crc32(data) != crc:
            raise ValueError(f"{self.path}: block {i} is damaged")
        return self.coder.decode(data, n)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """The documents in order; one block and one document are held at a time."""
        blocks = iter(range(len(self.checkpoints)))
        rest, parts, have = np.zeros(0, np.uint32), [], 0
        for doc, size in zip(self.docs, self.sizes.tolist(), strict=True):
            parts, have = [rest], len(rest)
            while have < size:
                part = self.block(next(blocks))
                parts.append(part)
                have += len(part)
            joined = np.concatenate(parts) if len(parts) > 1 else rest
            yield doc, joined[:size]
            rest = joined[size:]


class UnitTokens:
    """Ids of whole texts by the tokenizers library, through a bounded cache.

    The pre-tokenizer's pattern joins a space to the word behind it, and no merge
    crosses its pieces; so a text in which no space stands beside other white space is
    divided before every space, and each unit goes through the library once while the
    cache holds it. A batch's units are told apart and looked up as one Arrow dictionary, and all
    ids of the batch are gathered at once from the flat array of the cached ones. Many new units go
    through the library as one text, whose ids are parted again at the tokens that begin with a space.
    Other texts go through it whole. The units that a full cache has no room for are forgotten after their batch.
    """

    def __init__(self, path: str, width: str, cache_units: int = CACHE_UNITS) -> None:
        import os

        from tokenizers import Tokenizer

        self.tokenizer, self.width, self.cache_units = Tokenizer.from_file(path), np.dtype(width), cache_units
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; more threads only hold memory
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(1 + max(tokens.values()), bool)
        self.begins[[i for t, i in tokens.items() if t.startswith("Ġ")]] = True
        #: The units of the cache, in the order of their entries.
        self.units = pa.array([], pa.string())
        self.flat, self.bounds, self.known = np.zeros(1 << 16, self.width), np.zeros(1 << 14, np.int64), 0

    def _put(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Add entries that follow each other in ids; the number of the first."""
        first, used = self.known, int(self.bounds[self.known])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(sizes) >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.flat[used : used + len(ids)] = ids
        self.bounds[first + 1 : first + 1 + len(sizes)] = used + np.cumsum(sizes)
        self.known += len(sizes)
        return first

    def _whole(self, texts: list[str]) -> np.ndarray:
        """Numbers of new entries with the ids of the texts."""
        if not texts:
            return np.zeros(0, np.int64)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        first = self._put(np.concatenate([np.array(x, self.width) for x in found]), np.array([len(x) for x in found]))
        return np.arange(first, first + len(texts))

    def _learn(self, units: list[str], at_once: int = 100) -> None:
        """Add units as new entries, in order."""
        for begin in range(0, len(units), 1000 * at_once):
            some = units[begin : begin + 1000 * at_once]
            groups = [some[i : i + at_once] for i in range(0, len(some), at_once)]
            found = self.tokenizer.encode_batch_fast(["".join([" " + u for u in g]) for g in groups], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, self.width) for e in found])
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) != len(some):
                raise ValueError("the tokenizer merges across spaces; its texts can't be divided there")
            self._put(ids, np.diff(np.r_[starts, len(ids)]))

    def encode(self, texts: pa.Array, end: int) -> Iterator[pa.Array]:
        """The ids of each text, then the id `end`, as little-endian numbers: binary arrays that follow each other."""
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            # as many texts as stay within the bound, one at least
            stop = max(at + 1, int(np.searchsorted(upto, BATCH_BYTES + (upto[at - 1] if at else 0), "right")))
            yield self._batch(texts.slice(at, stop - at), end)
            at = stop

    def _batch(self, texts: pa.Array, end: int) -> pa.Array:
        kept = self.known
        texts = pc.fill_null(texts, "")
        apart = pc.match_substring_regex(texts, BESIDE_SPACE).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(apart), "", texts) if apart.any() else texts, " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        stops = np.cumsum(counts)
        heads, rows = stops - counts, np.arange(len(texts))
        words = lists.flatten()
        # a text's first piece has no space before it: heads are entries of their own
        first_pieces = words.take(pa.array(heads)).to_pylist()
        own = self._whole([t if a else f for t, a, f in zip(texts.to_pylist(), apart, first_pieces, strict=True)])
        finish = self._put(np.array([end], self.width), np.array([1]))
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        number = pc.index_in(distinct, self.units).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(number < 0)
        missing = distinct.take(pa.array(new))
        number[new] = np.arange(self.known, self.known + len(new))
        self._learn(missing.to_pylist())
        chain = np.empty(len(words) + len(rows), np.int32)
        places = np.arange(len(words), dtype=np.int32) + np.repeat(rows.astype(np.int32), counts)
        chain[places] = number[coded.indices.to_numpy()]
        chain[places[heads]] = own
        chain[stops + rows] = finish
        begins = self.bounds[chain]
        sizes = self.bounds[chain + 1] - begins
        upto = np.cumsum(sizes)
        begins -= upto
        begins += sizes
        at = np.repeat(begins, sizes)
        at += np.arange(len(at))
        ids = self.flat[at]
        ends = np.r_[0, upto[stops + rows]] * self.width.itemsize
        self._forget(kept, missing, number[new])
        return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.tobytes())])

    def _forget(self, kept: int, learnt: pa.Array, entries: np.ndarray) -> None:
        """Keep the newly learnt units that the cache has room for, next to those of before; drop everything else of the batch."""
        stay = min(len(learnt), max(0, self.cache_units - len(self.units)))
        entries = entries[:stay]
        sizes = self.bounds[entries + 1] - self.bounds[entries]
        first = int(self.bounds[entries[0]]) if stay else 0
        ids = self.flat[first : first + int(sizes.sum())].copy()  # learnt in order, so they follow each other
        self.known = kept
        self._put(ids, sizes)
        if stay:
            self.units = pa.concat_arrays([self.units, learnt.slice(0, stay)])


@lru_cache(1)
def unit_tokens(path: str, width: str) -> UnitTokens:
    """One for each worker process, so that later tasks find its cache filled."""
    return UnitTokens(path, width)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenised(docs: DataFrame, id_column: str, text_column: str, vocabulary: str, end: int, width: str) -> DataFrame:
    """(doc_id, ids): the packed ids of each whole text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = unit_tokens(vocabulary, width)
        for batch in batches:
            at = 0
            for ids in units.encode(batch.column("text"), end):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(ids)), ids.cast(pa.binary())], ["doc_id", "ids"])
                at += len(ids)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(encode, "doc_id long, ids binary")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode all texts and write them in ascending order of their ids; returns the table of files.

    The result has one row per file: url, first (an ordering key), tokens, documents.
    A null text is empty, so it has the end id only. Null ids come first; rows with
    equal ids follow each other by a hash of their tokens. The shared frequencies are those of all
    documents. Texts of any length are encoded whole. Other columns are ignored; an empty table gives no file.

    Texts are encoded where they lie; only their ids are shuffled into order. Rows of one id, however many, are
    divided among tasks by their content and place.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    with open(vocabulary, encoding="utf-8") as f:
        data = json.load(f)
    size = 1 + max(end, *data["model"]["vocab"].values(), *(x["id"] for x in data["added_tokens"]))
    width = "<u2" if size <= 1 << 16 else "<u4"
    packed = tokenised(docs, id_column, text_column, vocabulary, end, width).withColumns({"mark": F.xxhash64("ids"), "row": F.monotonically_increasing_id()})
    ids, ids_path = staged_at(packed, "token-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids = batch.column("ids").cast(pa.large_binary())
            bounds = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
            if len(ids):
                total += np.bincount(np.frombuffer(ids.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(width), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["token", "n"])

    counts = np.zeros(size, np.int64)
    for row in ids.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.token] = row.n  # at most one row for each id of the vocabulary
    table = spark.sparkContext.broadcast(scaled(counts))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file, follows, found = Coder(table.value), None, None, []
        for batch in batches:
            for doc, x, at in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("at").to_pylist(), strict=True):
                if file and (at != follows or file.tokens + file.held >= FILE_TOKENS):
                    file.close()
                    found.append((file.url, file.first, file.tokens, len(file.docs)))
                    file = None
                if not file:
                    url = f"{folder}/{at:020d}-{uuid.uuid4().hex}.tok"
                    file = TokenFileWriter(url, coder)
                    file.url, file.first = url, at
                file.add(doc, np.frombuffer(x.as_buffer(), width))
                follows = at + 1
        if file:
            file.close()
            found.append((file.url, file.first, file.tokens, len(file.docs)))
        yield pa.RecordBatch.from_pylist([dict(zip(("url", "first", "tokens", "documents"), x, strict=True)) for x in found], pa.schema([("url", pa.string()), ("first", pa.int64()), ("tokens", pa.int64()), ("documents", pa.int64())]))

    made, path = opened(folder)
    made.create_dir(path, recursive=True)
    ordered = ids.repartitionByRange("doc_id", "mark", "row").sortWithinPartitions("doc_id", "mark", "row")
    numbered = ordered.select("doc_id", "ids", F.monotonically_increasing_id().alias("at"))
    files = staged(numbered.mapInArrow(write, "url string, first long, tokens long, documents long"), "token-files")
    remove(spark, ids_path)
    return files


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files of write_token_files."""
    begun = files.selectExpr("url", "sum(tokens) over (order by first) - tokens AS start")  # one row per file

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders: dict = {}
        for batch in batches:
            for url, start in zip(batch.column("url").to_pylist(), batch.column("start").to_pylist(), strict=True):
                docs, starts, sizes, sums = [], [], [], []
                for doc, ids in TokenFile(url, coders).documents():
                    docs.append(doc)
                    starts.append(start)
                    sizes.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4", copy=False)))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = begun.repartition(max(1, files.count()), F.xxhash64("url"))
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, **options) -> DataFrame:
    """Write the documents as token files in the shared folder and read them back."""
    return read_token_files(write_token_files(docs, fresh_path(docs.sparkSession, "tokens"), **options))
