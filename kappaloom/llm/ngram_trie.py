"""Log probabilities of texts under a smoothed n-gram model of words, kept in sharded Elias-Fano tries.

Texts are read once and written as blocks of token numbers with a vocabulary of their own. Words are counted by shards
of their hash, which gives every word of the corpus its id and count. Then, order by order, a block asks for each of its distinct n-grams once: with how often it
stands in the block's training texts, and what is known of its context. The shard of a context adds the counts up, smooths and quantises the
probabilities, writes them as a trie, maps its file, and answers all that was asked by lookups in it. An answer is a byte for every n-gram in
the order asked, so what travels is little more than the n-grams themselves.

The model is a hierarchy of Dirichlet priors: a word's probability after a context that occurs c times is (n + m p) / (c + m), with p
its probability after the context without its first word, and (n + 1) / (N + V + 1) in the end. These add up to one over all words and one unknown, before they are quantised. A context that was
not trained leaves p. It needs no number of a whole context but its count, so a hot context's n-grams are dealt to all shards by their last words.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elias_fano import Trie, numbered
from .shared import forget, fresh_path, opened, release, remove, staged_at, tidied

#: Words of an n-gram; tokens of a block and n-grams of a shard, about; training occurrences from which a context is dealt by the last words too.
ORDER, BLOCK_TOKENS, SHARD_ROWS, HOT = 2, 1 << 20, 1 << 21, 1 << 17
#: The weight of the shorter context's probability, in occurrences, after one word and after more: the best of some on a held-out part.
PRIORS = (400.0, 3.0)
#: Steps of a quantised probability for a factor of ten; the byte of an n-gram that is not in the trie.
STEPS, ABSENT = 16, 255
#: Local numbers of what stands before a text and after it.
BEGIN, END = 0, 1
#: Blocks whose answers share a folder.
FOLD = 63


def held_out(id_: Column) -> Column:
    """Whether a document is one that the model does not learn from; a null id is not."""
    return F.coalesce(F.crc32(id_.cast("string")) % 7 == 2, F.lit(False))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, A-Z in lower case, and how many each text has.

    >>> [x.tolist() for x in map(np.array, words_of(pa.array([" A\\tb ", None, "É\\xa0a"])))]
    [['a', 'b', 'É\\xa0a'], [2, 0, 1]]
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = pc.list_flatten(parts)
    whole = pc.not_equal(flat, "").to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(whole)])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return flat.filter(pa.array(whole.astype(bool))), np.diff(upto[ends])


def packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as compressed bytes, all lowest bytes first, then the next ones.

    >>> [x.tolist() for x in unpacked(packed(np.array([1, 300]), np.zeros(0), np.array([1 << 40])))]
    [[1, 300], [], [1099511627776]]
    """
    out = [np.array([len(columns)], "<i8").tobytes()]
    for c in columns:
        planes = np.ascontiguousarray(np.asarray(c, "<i8")).view(np.uint8).reshape(-1, 8)
        width = 8
        while width and not planes[:, width - 1].any():
            width -= 1
        out += [np.array([len(c), width], "<i8").tobytes(), np.ascontiguousarray(planes[:, :width].T).tobytes()]
    data = b"".join(out)
    return np.array([len(data)], "<i8").tobytes() + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    size = int(np.frombuffer(data, "<i8", 1)[0])
    raw, at, out = pa.decompress(memoryview(data)[8:], size, "zstd", asbytes=True), 8, []
    for _ in range(int(np.frombuffer(raw, "<i8", 1)[0])):
        n, width = np.frombuffer(raw, "<i8", 2, at).tolist()
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n).T
        out.append(planes.view("<i8")[:, 0])
        at += 16 + n * width
    return out


class Blocks:
    """Gathers texts to blocks of about `size` tokens; a longer text goes on in the next block, with the words before as context."""

    def __init__(self, lead: int, size: int) -> None:
        self.lead, self.size = lead, size
        self._fresh()

    def _fresh(self) -> None:
        self.pieces: list[tuple] = []
        self.held = 0

    def add(self, at: int, doc_id: int | None, held: bool, words: pa.Array) -> Iterator[dict]:
        n, done = len(words), 0
        if self.held and self.held + n + 1 > self.size:
            yield self.told()
        while True:
            take = min(n - done, self.size)
            before = min(self.lead, done)
            last = done + take == n
            self.pieces.append((at, doc_id, held, self.lead - before, before, words.slice(done - before, before + take), last))
            self.held += take + last
            done += take
            if last:
                return
            yield self.told()

    def told(self) -> dict:
        """The block's row: its words, how often each stands in training texts, its tokens, and its pieces."""
        coded = pa.concat_arrays([p[5] for p in self.pieces]).dictionary_encode()
        numbers, tokens, pieces, learnt, at = coded.indices.to_numpy().astype(np.int64) + 2, [], [], [], 0
        for row, doc_id, held, begins, before, words, last in self.pieces:
            tokens += [np.full(begins, BEGIN, np.int64), numbers[at : at + len(words)], np.full(int(last), END, np.int64)]
            at += len(words)
            pieces.append({"at": row, "doc_id": doc_id, "held": held, "n": len(words) - before + last})
            learnt += [np.zeros(begins + before, bool), np.full(pieces[-1]["n"], not held)]
        flat = np.concatenate(tokens)
        crcs = np.fromiter(map(zlib.crc32, (b" ", *coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False))), np.int64, len(coded.dictionary) + 1)
        uses = np.bincount(flat[np.concatenate(learnt)], minlength=len(coded.dictionary) + 2)
        out = {"words": coded.dictionary, "crcs": packed(crcs), "uses": packed(uses[1:]), "tokens": packed(flat), "pieces": pieces, "size": self.held}
        self._fresh()
        return out


_BLOCK = "words array<string>, crcs binary, uses binary, tokens binary, pieces array<struct<at: long, doc_id: long, held: boolean, n: int>>, size long"
_PIECES = pa.list_(pa.struct([("at", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("n", pa.int32())]))


def _listed(words: pa.Array) -> pa.Array:
    """One list of all words."""
    return pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)


def _blocks(docs: DataFrame, lead: int, size: int) -> tuple[DataFrame, str]:
    """The blocks (block, words, crcs, uses, tokens, pieces, size) of docs (at, doc_id, held, text), in a table of their own."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(lead, size)

        def row(b: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [_listed(b["words"]), *(pa.array([b[x]], pa.binary()) for x in ("crcs", "uses", "tokens")), pa.array([b["pieces"]], _PIECES), pa.array([b["size"]], pa.int64())],
                ["words", "crcs", "uses", "tokens", "pieces", "size"],
            )

        for batch in batches:
            flat, counts = words_of(batch.column("text"))
            ends = np.cumsum(counts)
            for i, (at, doc_id, held) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("at", "doc_id", "held")), strict=True)):
                for b in blocks.add(at, doc_id, held, flat.slice(int(ends[i] - counts[i]), int(counts[i]))):
                    yield row(b)
        if blocks.pieces:
            yield row(blocks.told())
        release()

    return staged_at(docs.mapInArrow(gather, _BLOCK).withColumn("block", F.monotonically_increasing_id()), "token-blocks")


def _scattered(keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of every shard, in their order."""
    # short numbers are sorted by their digits
    order = np.argsort(keys.astype(np.uint16) if keys.max(initial=0) < 1 << 16 else keys, kind="stable")
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0])) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(bounds, [*bounds[1:], len(order)], strict=False):
        yield int(keys[order[a]]), [c[order[a:b]] for c in columns]


class Answers:
    """Answers (block, shard, payload), sorted by block in folders that FOLD blocks or fewer share, for the tasks that read the blocks."""

    def __init__(self, rows: DataFrame, blocks: int, label: str) -> None:
        self.path, self.folders = fresh_path(rows.sparkSession, label), blocks // FOLD * 2 + 1
        dealt = rows.withColumn("folder", F.pmod("block", F.lit(self.folders))).repartition("block").sortWithinPartitions("folder", "block")
        with tidied(rows.sparkSession):
            dealt.write.partitionBy("folder").option("parquet.block.size", 8 << 20).parquet(self.path)

    def of(self, block: int) -> dict[int, bytes]:
        system, path = opened(f"{self.path}/folder={block % self.folders}")
        told: dict[int, bytes] = {}
        for name in sorted(f.path for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")):
            # most files hold other blocks, which their footers tell
            with pq.ParquetFile(name, filesystem=system) as file:
                spans = [(i, file.metadata.row_group(i).column(file.schema_arrow.get_field_index("block")).statistics) for i in range(file.num_row_groups)]
                if groups := [i for i, s in spans if s is None or not s.has_min_max or s.min <= block <= s.max]:
                    rows = file.read_row_groups(groups, ["block", "shard", "payload"], use_threads=False)
                    rows = rows.filter(pc.equal(rows.column("block"), block))
                    told |= zip(rows.column("shard").to_pylist(), rows.column("payload").to_pylist(), strict=True)
        return told


def _counted_words(blocks: DataFrame, shards: int) -> DataFrame:
    """(block, shard, payload, total, known): of the words of a block in a shard the ids, equal for equal words of all blocks, and counts; and in a row without a block the shard's tokens and distinct words that are trained."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (block, crcs, uses) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("block", "crcs", "uses")), strict=True)):
                words = pa.concat_arrays([pa.array([" "]), batch.column("words")[i].values])  # the end first, as no word
                for s, (at, n) in _scattered(unpacked(crcs)[0] % shards, np.arange(len(words)), unpacked(uses)[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([block]), _listed(words.take(pa.array(at))), pa.array([packed(n)], pa.binary())], ["shard", "block", "words", "uses"])

    def count(part: pa.Table) -> pa.Table:
        shard, lists = part.column("shard")[0].as_py(), part.column("words").combine_chunks()
        coded = pc.list_flatten(lists).dictionary_encode()
        rank = coded.indices.to_numpy()
        uses = np.concatenate([unpacked(x)[0] for x in part.column("uses").to_pylist()])
        sums = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(sums, rank, uses)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).tolist()
        told = [packed(rank[a:b] * shards + shard, sums[rank[a:b]]) for a, b in zip([0, *ends], ends, strict=False)]
        blocks, none = part.column("block").to_pylist(), [None] * len(told)
        columns = ([*blocks, None], [shard] * (len(blocks) + 1), [*told, None], [*none, int(sums.sum())], [*none, int((sums > 0).sum())])
        return pa.table([pa.array(c, pa.binary() if i == 2 else pa.int64()) for i, c in enumerate(columns)], ["block", "shard", "payload", "total", "known"])

    asked = blocks.select("block", "words", "crcs", "uses").mapInArrow(ask, "shard long, block long, words array<string>, uses binary")
    return asked.groupBy("shard").applyInArrow(count, "block long, shard long, payload binary, total long, known long")


def prior(order: int) -> float:
    return PRIORS[min(order, 3) - 2]


def quantised(p: np.ndarray) -> np.ndarray:
    """Probabilities as numbers of steps below 1, up to 254."""
    return np.clip(np.rint(-np.log10(p) * STEPS), 0, ABSENT - 1).astype(np.int64)


class View:
    """A block with what is known of its tokens: scores so far, and counts of the n-grams that end at each."""

    def __init__(self, block: int, crcs: bytes, tokens: bytes, pieces: list[dict], lead: int, shards: int, total: int, known: int, hot: int, told: dict[int, bytes]) -> None:
        self.block, self.pieces, self.hot = block, pieces, hot
        self.tokens = unpacked(tokens)[0]
        of = unpacked(crcs)[0] % shards
        self.ids, counts = np.full(len(of) + 1, -1), np.zeros(len(of) + 1, np.int64)
        for s, (at,) in _scattered(of, np.arange(1, len(of) + 1)):
            self.ids[at], counts[at] = unpacked(told[s])
        self.trained = int(counts[END])  # texts
        sizes = np.array([p["n"] + lead for p in pieces], np.int64)
        starts = np.cumsum(sizes) - sizes
        self.inside = np.arange(len(self.tokens)) - np.repeat(starts, sizes)
        self.scored = self.inside >= lead
        self.learnt = self.scored & ~np.repeat(np.array([p["held"] for p in pieces], bool), sizes)
        self.lead, self.starts = lead, starts
        self.uses = counts[self.tokens]
        # each token's word, 0 before a text, and a number of the n-gram of the last round's order that ends at it
        self.words, self.ranks = self.ids[self.tokens] + 1, self.tokens
        self.base = np.log10((self.uses + 1) / (total + known + 1))
        # after a round of an order: the n-grams' counts and codes, and scores, of each token
        self.counts, self.codes, self.scores = np.where(self.tokens == BEGIN, self.trained, self.uses), self.uses, self.base

    def asked(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct n-grams whose context was trained: a token where each stands, which n-gram every such token has, the tokens, and the contexts' counts."""
        context = np.concatenate([[0], self.counts[:-1]])
        at = np.flatnonzero((self.inside >= order - 1) & (self.tokens != BEGIN) & (context > 0))
        # an n-gram is its context's number and its last token; in the order of these keys, which keeps what is sent small
        bits, room = max(1, int(self.tokens.max(initial=0)).bit_length()), len(at).bit_length()
        keys = self.ranks[at - 1] << bits | self.tokens[at]
        if int(keys.max(initial=0)).bit_length() + room <= 63:
            # sorted with their places, which is faster than to sort the places
            keys = np.sort(keys << room | np.arange(len(keys)))
            order_ = keys & ((1 << room) - 1)
            keys >>= room
        else:
            order_ = np.argsort(keys)
            keys = keys[order_]
        fresh = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
        which, first = np.empty(len(keys), np.int64), order_[fresh]
        which[order_] = np.cumsum(fresh) - 1
        return at[first], which, at, context

    def grams(self, first: np.ndarray, order: int) -> list[np.ndarray]:
        """The ids of n-grams that end at tokens, word by word: the context's from the nearest word on, then the last word's."""
        return [self.words[first - i] for i in [*range(1, order), 0]]

    def questions(self, order: int, shards: int) -> Iterator[tuple[int, bytes]]:
        """For every shard its n-grams in the order of their ids, how often they are trained, their contexts' counts, and what is known of their last part."""
        first, which, at, context = self.asked(order)
        grams = self.grams(first, order)
        n = np.bincount(which[self.learnt[at]], minlength=len(first))
        for s, columns in _scattered(self.dealt(grams, context[first], shards), *grams, n, context[first], np.where(n > 0, self.codes[first], 0)):
            yield s, packed(*columns)

    def dealt(self, grams: list[np.ndarray], context: np.ndarray, shards: int) -> np.ndarray:
        """The shard of each n-gram: by its context, and by the last word too where the context is hot."""
        mixed = np.zeros(len(context), np.uint64)
        for part in [*grams[:-1], np.where(context > self.hot, grams[-1], 0)]:
            mixed = (mixed + part.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return (mixed % np.uint64(shards)).astype(np.int64)

    def answered(self, order: int, shards: int, told: dict[int, bytes]) -> None:
        """Takes the answers of an order's round."""
        first, which, at, context = self.asked(order)
        codes, counts = np.full(len(first), ABSENT), np.zeros(len(first), np.int64)
        for s, (rows,) in _scattered(self.dealt(self.grams(first, order), context[first], shards), np.arange(len(first))):
            codes[rows], counts[rows] = unpacked(told[s])
        scores, after = self.scores.copy(), np.where(self.tokens == BEGIN, self.trained, 0)
        own = codes[which]
        kept, ranks = np.full(len(self.tokens), ABSENT), np.zeros(len(self.tokens), np.int64)
        kept[at], ranks[at], after[at] = own, which + 1, counts[which]
        scores[at] = -own / STEPS
        lost = at[own == ABSENT]
        scores[lost] = self.scores[lost] + np.log10(prior(order) / (context[lost] + prior(order)))
        self.scores, self.counts, self.codes, self.ranks = scores, after, kept, ranks

    def sums(self) -> list[np.ndarray]:
        """Of every piece: its tokens, those known, and the base and model's scores."""
        add = lambda x: np.add.reduceat(np.where(self.scored, x, 0), self.starts) if len(self.starts) else np.zeros(0)
        return [add(self.scored.astype(np.int64)), add((self.uses > 0).astype(np.int64)), add(self.base), add(self.scores)]


def _views(model: dict, answers: list[Answers]) -> Callable[[pa.RecordBatch], Iterator[View]]:
    """What reads the blocks of a batch, with the answers so far."""

    def read(batch: pa.RecordBatch) -> Iterator[View]:
        for i in range(batch.num_rows):
            block, crcs, tokens, pieces = (batch.column(x)[i].as_py() for x in ("block", "crcs", "tokens", "pieces"))
            view = View(block, crcs, tokens, pieces, model["lead"], model["word_shards"], model["total"], model["known"], model["hot"], answers[0].of(block))
            for order, told in enumerate(answers[1:], 2):
                view.answered(order, model["shards"], told.of(block))
            yield view

    return read


def _sorted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of n-grams (words, rows) by their words, and in this order where another n-gram begins.

    >>> [x.tolist() for x in _sorted(np.array([[1 << 40, 3, 1 << 40], [1 << 40, 1 << 40, 1 << 40]]))]
    [[1, 0, 2], [True, True, False]]
    """
    key, used = np.zeros(grams.shape[1], np.int64), 0
    for column in numbered(grams)[1]:
        bits = int(column.max(initial=0)).bit_length()
        if used + bits > 63:
            # no room for all words in a key: the first ones' are numbered anew
            key = np.unique(key, return_inverse=True)[1]
            used = int(key.max(initial=0)).bit_length()
        key, used = key << bits | column, used + bits
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return order, new


def _learnt(part: pa.Table, order: int, total: int, known: int, path: str) -> pa.Table:
    """One shard: adds the counts up, writes the trie of smoothed probabilities, and answers the blocks by lookups in its file."""
    shard, blocks = part.column("shard")[0].as_py(), part.column("block").to_pylist()
    asked = [unpacked(x) for x in part.column("payload").to_pylist()]
    grams = np.stack([np.concatenate([c[i] for c in asked]) for i in range(order)])
    n, context, lower = (np.concatenate([c[order + i] for c in asked]) for i in range(3))
    ends = np.cumsum([len(c[0]) for c in asked]).tolist()
    del asked
    order_, new = _sorted(grams)
    firsts = np.flatnonzero(new)
    # of each n-gram, whichever blocks asked: those that train it know of its last part, the others say 0
    add = lambda how, x: how.reduceat(x[order_], firsts) if len(firsts) else np.zeros(0, np.int64)
    sums, lower = add(np.add, n), add(np.maximum, lower)
    grams, context = np.ascontiguousarray(grams[:, order_[firsts]]).T, context[order_[firsts]]
    learnt = np.flatnonzero(sums)
    known_ = lower[learnt]
    below = (known_ + 1) / (total + known + 1) if order == 2 else 10.0 ** (-known_ / STEPS)
    trie = Trie.of(grams[learnt], quantised((sums[learnt] + prior(order) * below) / (context[learnt] + prior(order))))
    sums = sums[learnt]
    del n, context, lower
    system, folder = opened(path)
    system.create_dir(folder, recursive=True)
    at = f"{folder}/{order}-{shard}-{uuid.uuid4().hex}.trie"
    with system.open_output_stream(at) as out:
        out.write(trie.to_bytes())
    if isinstance(system, fs.LocalFileSystem):
        mapped = Trie.from_buffer(np.memmap(at, np.uint8, "r"))
    else:
        with system.open_input_file(at) as f:
            mapped = Trie.from_buffer(np.frombuffer(f.read(), np.uint8))
    place = mapped.find(grams)
    there, which = place >= 0, np.cumsum(new) - 1
    own, often = np.full(len(place), ABSENT), np.zeros(len(place), np.int64)
    own[there], often[there] = mapped.codes[place[there]], sums[place[there]]
    codes, counts = np.empty(len(which), np.int64), np.empty(len(which), np.int64)
    codes[order_], counts[order_] = own[which], often[which]
    # no later task reads the file, and the disk holds those of all shards that are under way and no more
    del mapped
    system.delete_file(at)
    told = [packed(codes[a:b], counts[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
    return pa.table([pa.array(blocks), pa.array([shard] * len(blocks)), pa.array(told, pa.binary())], ["block", "shard", "payload"])


def score_texts(docs: DataFrame, order: int = ORDER, id_column: str = "doc_id", text_column: str = "text", block_tokens: int = BLOCK_TOKENS, shard_rows: int = SHARD_ROWS, hot: int = HOT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Tokens are the words of the text, with A-Z in lower case, and one end; n_known of them stand in training texts, which are those not
    held_out() and have train_tokens tokens in all. base_score is the sum of log10 of (n + 1) / (N + V + 1) over the tokens. score is the text's log10
    probability under the model of n-grams of `order` words, quantised in steps of 1 / STEPS.

    Null, empty and blank texts have the end alone. A null id is trained on; repeated rows are texts of their own and come out as often as they came; texts of any length are
    read whole, in several blocks; without a training text all probabilities are 1. An empty table gives an empty result; other columns are left out, whatever their names.
    """
    if order < 2:
        raise ValueError("the model has n-grams of two words at least")
    spark, lead = docs.sparkSession, order - 1
    rows = docs.select(F.monotonically_increasing_id().alias("at"), F.col(id_column).cast("long").alias("doc_id"), held_out(F.col(id_column)).alias("held"), F.col(text_column).cast("string").alias("text"))
    blocks, blocks_path = _blocks(rows, lead, block_tokens)
    n_blocks, size = blocks.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = math.ceil(size / shard_rows) or 1
    with tidied(spark):
        counted, counted_path = staged_at(_counted_words(blocks, shards), "word-counts")
    found = counted.agg(F.sum("total"), F.sum("known")).first()
    model = {"lead": lead, "word_shards": shards, "shards": shards, "hot": hot, "total": found[0] or 0, "known": found[1] or 0}
    answers = [Answers(counted.where("block IS NOT NULL").select("block", "shard", "payload"), n_blocks, "word-answers")]
    remove(spark, counted_path)
    forget(spark)
    tries = fresh_path(spark, "tries")
    for k in range(2, order + 1):
        views = _views(model, list(answers))

        def ask(batches: Iterator[pa.RecordBatch], k: int = k, views: Callable = views) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for view in views(batch):
                    for s, payload in view.questions(k, model["shards"]):
                        yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([view.block]), pa.array([payload], pa.binary())], ["shard", "block", "payload"])
            release()

        def learn(part: pa.Table, *, k: int = k) -> pa.Table:
            out = _learnt(part, k, model["total"], model["known"], tries)
            release()
            return out

        asked = blocks.select("block", "crcs", "tokens", "pieces").mapInArrow(ask, "shard long, block long, payload binary")
        answers.append(Answers(asked.groupBy("shard").applyInArrow(learn, "block long, shard long, payload binary"), n_blocks, "answers"))
        del asked
        forget(spark)
    views = _views(model, list(answers))
    names = ["at", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for view in views(batch):
                kept = [pa.array([p[x] for p in view.pieces], t) for x, t in (("at", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()))]
                tokens, known, base, own = view.sums()
                yield pa.RecordBatch.from_arrays([*kept, pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())], names)
        release()

    scored, _ = staged_at(blocks.select("block", "crcs", "tokens", "pieces").mapInArrow(score, "at long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "scores")
    remove(spark, blocks_path, tries, *(a.path for a in answers))
    whole = scored.groupBy("at").agg(*[F.first(x).alias(x) for x in ("doc_id", "held_out")], *[F.sum(x).alias(x) for x in names[3:]])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model["total"]).cast("long").alias("train_tokens"), "base_score", "score")
