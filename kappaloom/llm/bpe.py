"""Byte-pair encoding and decoding by batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. Every round looks up
the merge rank of each neighbouring pair by binary search over the sorted pair
keys, takes the lowest rank of every word, merges all its places from the left,
and drops the right halves; only pairs beside a merge are looked up again. A word
leaves when none of its pairs has a rank.

Merging all places of a pair in one round equals merging them one by one as long
as no merge that uses a symbol ranks before the merge that makes it; the table is
checked for that when it is loaded.

Texts are divided at white space, which no token crosses, and each piece is
encoded once per worker while a cache of bounded size holds it.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces kept per worker; the cache is emptied when it would grow beyond.
CACHE_PIECES = 250_000
#: Characters taken together; bounds the memory of a batch but for a single longer text.
BATCH_CHARS = 2_000_000

# Fixed values of the tokenizer: its pre-tokenizer's pattern and its white space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
SEPARATORS = regex.compile(rf"[{SPACE}]+")
WORD_END = "</w>"
#: Beyond these, characters may be newer than Python's Unicode data; see Encoder._ids.
FAMILIAR = regex.compile("[^\x00-\u024f]")
#: Characters that Python takes for white space and the tokenizer does not.
UNLIKE_SPACE = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


@dataclass
class Merges:
    """A merge table: sorted pair keys with rank and result, and the symbols of bytes inside and at the end of words."""

    tokens: list[str]
    keys: np.ndarray
    ranks: np.ndarray
    results: np.ndarray
    inner: np.ndarray
    final: np.ndarray
    special: dict[str, int]
    source: str = field(repr=False, default="")

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocabulary: dict[str, int] = data["model"]["vocab"]
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        tokens = [""] * (1 + max([*vocabulary.values(), *special.values()]))
        for token, i in [*vocabulary.items(), *special.items()]:
            tokens[i] = token
        pairs = [x if isinstance(x, list) else x.split(" ") for x in data["model"]["merges"]]
        a, b = (np.array([vocabulary[x[i]] for x in pairs], np.int64) for i in (0, 1))
        made = np.array([vocabulary[x + y] for x, y in pairs], np.int64)
        rank = np.arange(len(pairs))
        born = np.full(len(tokens), -1)
        np.maximum.at(born, made, rank)
        if (born[a] > rank).any() or (born[b] > rank).any():
            raise ValueError("a merge ranks before the merge that makes one of its symbols; rounds of whole pairs would not be exact")
        keys = a * len(tokens) + b
        order = np.argsort(keys)
        symbols = byte_symbols()
        return cls(
            tokens,
            keys[order],
            rank[order].astype(np.int32),
            made[order].astype(np.int32),
            np.array([vocabulary[s] for s in symbols], np.int32),
            np.array([vocabulary[s + WORD_END] for s in symbols], np.int32),
            special,
            json.dumps(data),
        )

    @property
    def none(self) -> int:
        return len(self.keys)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each pair among the sorted keys and its rank, `none` if it is no merge."""
        want = left.astype(np.int64) * len(self.tokens) + right
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return at, np.where(self.keys[at] == want, self.ranks[at], self.none).astype(np.int32)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all words in order, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(sizes)
        filled = sizes > 0
        symbols[ends[filled] - 1] = self.final[flat[ends[filled] - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [], []
        ranks = self._ranks(symbols, word)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            ready = least == self.none
            if ready.any():
                out = np.repeat(ready, lengths)
                done_symbols.append(symbols[out])
                done_words.append(word[out])
                symbols, word, ranks = symbols[~out], word[~out], ranks[~out]
                least, lengths = least[~ready], lengths[~ready]
                if not len(symbols):
                    break
            chosen = ranks == np.repeat(least, lengths)
            hits = np.flatnonzero(chosen)
            # of places that overlap, as in "aaa", every other one from the left
            run = np.r_[True, np.diff(hits) != 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - first) % 2 == 0]
            at, _ = self.lookup(symbols[hits], symbols[hits + 1])
            symbols[hits] = self.results[at]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
            new = moved[hits]
            beside = np.zeros(len(symbols), bool)
            beside[new] = True
            beside[new[new > 0] - 1] = True
            again = np.flatnonzero(beside)
            ranks[again] = self._ranks(symbols, word, again)
        if not done_symbols:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        ids, of = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=len(words))

    def _ranks(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The rank of the pair that begins at each place (or at the places `at`); the last of a word has none."""
        at = np.arange(len(symbols)) if at is None else at
        out = np.full(len(at), self.none, np.int32)
        inside = at < len(symbols) - 1
        inside[inside] = word[at[inside]] == word[at[inside] + 1]
        begin = at[inside]
        out[inside] = self.lookup(symbols[begin], symbols[begin + 1])[1]
        return out


@dataclass
class Encoder:
    """Texts to ids and back to text, through a bounded cache of white-space separated pieces."""

    merges: Merges
    cache_pieces: int = CACHE_PIECES

    def __post_init__(self) -> None:
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    @cached_property
    def _special(self) -> regex.Pattern:
        return regex.compile("(" + "|".join(regex.escape(s) for s in self.merges.special) + ")")

    @cached_property
    def _library(self):  # noqa: ANN202
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.merges.source)

    def split(self, text: str) -> list[str]:
        """The pieces between white space as the tokenizer sees it."""
        if UNLIKE_SPACE.search(text):
            return [x for x in SEPARATORS.split(text) if x]
        return text.split()

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that the cache lacks."""
        missing = [x for x in pieces if x not in self.ids]
        if not missing:
            return
        if len(self.ids) + len(missing) > self.cache_pieces:
            self.ids, self.decoded = {}, {}
            missing = list(pieces)
        marked, plain = [], missing
        if self._special.search("\n".join(missing)):
            marked = [x for x in missing if self._special.search(x)]
            plain = [x for x in missing if not self._special.search(x)]
        if strange := {x for x in plain if FAMILIAR.search(x) and any(unicodedata.category(c) == "Cn" for c in x)}:
            # what class a character has that Python does not know, only the tokenizers library can tell
            plain = [x for x in plain if x not in strange]
            for piece in strange:
                self._put(piece, self._library.encode(piece, add_special_tokens=False).ids)
        for piece, ids in zip(plain, self._ids(plain), strict=True):
            self._put(piece, ids)
        for piece in marked:
            parts = [p for p in self._special.split(piece) if p]
            found = iter(self._ids([p for p in parts if p not in self.merges.special]))
            self._put(piece, [i for p in parts for i in ([self.merges.special[p]] if p in self.merges.special else next(found))])

    def _put(self, piece: str, ids: list[int]) -> None:
        self.ids[piece] = " ".join(map(str, ids))
        self.decoded[piece] = " ".join([self.merges.tokens[i] for i in ids])

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece; a piece holds no white space."""
        joined = "\n".join(pieces)
        if not joined.isascii():
            joined = unicodedata.normalize("NFC", joined).replace("Σ", "σ")  # lower() would look at the context of a sigma
        words: list[bytes] = []
        bounds = [0]
        for word in PIECES.findall(joined.lower()):
            if word == "\n":
                bounds.append(len(words))
            else:
                words.append(word.encode("utf-8", "surrogatepass"))
        bounds.append(len(words))
        ids, counts = self.merges.encode(words)
        ends = np.r_[0, np.cumsum(counts)][bounds].tolist()
        ids = ids.tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)] if pieces else []

    def batches(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text: the number of ids, the decimal ids joined by a space, the decoded text."""
        at = 0
        while at < len(texts):
            chars, end = 0, at
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= BATCH_CHARS):
                chars += len(texts[end] or "")
                end += 1
            split = [self.split(t or "") for t in texts[at:end]]
            self.learn(set().union(*split))
            for pieces in split:
                ids = " ".join(map(self.ids.__getitem__, pieces))
                yield (ids.count(" ") + 1 if ids else 0), ids, " ".join(map(self.decoded.__getitem__, pieces))
            at = end


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """(id, *outputs) for every row: the ids of each text and the text decoded from them.

    outputs: any of n_tokens, ids (an array), decoded, ids_sha256 (of the decimal
    ids joined by one space) and decoded_sha256, in lowercase hex. A null or blank
    text has no ids and decodes to the empty text. Null ids, repeated rows and other
    columns of docs do not matter; an empty table gives an empty result. The merge
    table is read on the driver and broadcast: its size is that of the vocabulary.
    """
    types = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(Merges.load(vocabulary or default_vocabulary()))

    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(table.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        make = {
            "n_tokens": lambda n, ids, text: n,
            "ids": lambda n, ids, text: np.array(ids.split(), np.int32),
            "decoded": lambda n, ids, text: text,
            "ids_sha256": lambda n, ids, text: sha(ids),
            "decoded_sha256": lambda n, ids, text: sha(text),
        }
        for part in texts:
            rows = [[make[c](*row) for c in outputs] for row in encoder.batches(part.tolist())]
            yield pd.DataFrame(rows, columns=list(outputs))

    encoded = F.pandas_udf(encode, ", ".join(f"{c} {types[c]}" for c in outputs))
    rows = docs.select(F.col(id_column), encoded(F.col(text_column).cast("string")).alias("encoded"))
    return rows.select(id_column, "encoded.*")
