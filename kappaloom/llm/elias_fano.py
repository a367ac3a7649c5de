"""Elias-Fano sequences and tries of n-grams over them, in flat arrays that can be mapped from a file.

A sequence of n numbers that never falls keeps the low bits of each packed side by side, and the high bits in unary: a one for every number, a
zero for every step of the high part. The places of ones and zeros are found by a directory of blocks, so that
a number is read, and the first one not below a given one is found, without unpacking the sequence; all for many queries at once.

A level of a trie holds the children of all nodes of the level above, one node's after the other's. A child's word is stored relative to its
siblings: to the last value before them, so that the level never falls. The children's pointers are such a sequence too. A lookup goes down
level by level, with a search for the successor among the siblings alone.
"""

from __future__ import annotations

import io

import numpy as np

#: Words of 64 bits in a block of the directory.
BLOCK = 4
#: Queries handled at once; bits of a stretch for each query in it, up to which it is unpacked.
AT_ONCE, UNPACKED = 1 << 17, 64


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th one, from 0, in each 64-bit word."""
    place, k = np.zeros(len(word), np.uint64), k.astype(np.uint64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count((word >> place) & np.uint64((1 << width) - 1)).astype(np.uint64)
        beyond = low <= k
        k = np.where(beyond, k - low, k)
        place = np.where(beyond, place + np.uint64(width), place)
    return place.astype(np.int64)


def numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, which are not negative, in their order, and the place among them of each. Ids are marked in a table, or sorted if most of it were empty.

    >>> [x.tolist() for x in numbered(np.array([[9, 2], [2, 1 << 40]]))]
    [[2, 9, 1099511627776], [[1, 0], [0, 2]]]
    """
    size = int(ids.max(initial=-1)) + 1
    if size > 16 * ids.size:
        names, places = np.unique(ids, return_inverse=True)
        return names, places.reshape(ids.shape)
    marks, places = np.zeros((size + 63) // 64 * 64, bool), np.empty(ids.shape, np.int64)
    marks[ids] = True
    words = np.packbits(marks, bitorder="little").view("<u8")
    counts = np.bitwise_count(words)
    before = np.cumsum(counts, dtype=np.int64) - counts
    for some, out in zip(np.atleast_2d(ids), np.atleast_2d(places), strict=True):
        word = some >> 6
        out[:] = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (some & 63).astype(np.uint64)) - np.uint64(1)))
    return np.flatnonzero(marks), places


class EliasFano:
    """A sequence that never falls.

    >>> s = EliasFano.of(np.array([3, 3, 7, 900, 901]))
    >>> s.at(np.array([0, 2, 4])).tolist(), s.successor(np.array([4, 900, 902]), np.array([0, 0, 0]), np.array([5, 5, 5])).tolist()
    ([3, 7, 901], [2, 3, 5])
    """

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.width, self.top = (int(x) for x in head)
        self.low, self.high, self.ones = low, high, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        width = max(0, (most // n).bit_length() - 1) if n else 0
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width:
            bits = np.arange(n, dtype=np.uint64) * np.uint64(width)
            rest, shift = values & np.uint64((1 << width) - 1), bits & np.uint64(63)
            # some number begins in every word up to the last one's, and one at most goes on from a word to the next
            words = (n - 1) * width // 64 + 1
            low[:words] = np.bitwise_or.reduceat(rest << shift, -(np.arange(words) * -64 // width))
            over = np.flatnonzero(shift + np.uint64(width) > 64)
            low[(over * width >> 6) + 1] |= rest[over] >> (np.uint64(64) - shift[over])
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        top = most >> width
        blocks = (n + top + 65) // (64 * BLOCK) + 1  # a word of zeros at the end
        marks = np.zeros(blocks * BLOCK * 64, bool)
        marks[places] = True
        high = np.packbits(marks, bitorder="little").view("<u8")
        counts = np.bitwise_count(high).reshape(blocks, BLOCK).sum(axis=1, dtype=np.int64)
        return cls(np.array([n, width, top], np.int64), low, high, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width, self.top], np.int64), self.low, self.high, self.ones]

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th one or zero in the high bits."""
        ahead = self.ones if one else np.arange(len(self.ones), dtype=np.int64) * (64 * BLOCK) - self.ones
        if len(k):
            # a stretch of which much is asked is unpacked as a whole
            first, last = np.searchsorted(ahead, [k.min(), k.max()], side="right").tolist()
            if (last - first + 1) * 64 * BLOCK <= UNPACKED * len(k):
                words = np.asarray(self.high[(first - 1) * BLOCK : last * BLOCK])
                places = np.flatnonzero(np.unpackbits((words if one else ~words).view(np.uint8), bitorder="little").view(bool))
                return places[k - ahead[first - 1]] + (first - 1) * (64 * BLOCK)
        block = np.searchsorted(ahead, k, side="right") - 1
        words = np.asarray(self.high).reshape(-1, BLOCK)[block]
        if not one:
            words = ~words
        upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        left = k - ahead[block]
        which = (upto <= left[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        left -= np.where(which > 0, upto[rows, which - 1], 0)
        return (block * BLOCK + which) * 64 + _select_in_word(words[rows, which], left)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bits = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (bits >> np.uint64(6)).astype(np.int64), bits & np.uint64(63)
        over = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | over) & np.uint64((1 << self.width) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i) << self.width) | self._low(i).astype(np.int64)

    def _run(self, place: np.ndarray) -> np.ndarray:
        """How many ones stand from a place in the high bits on, up to 64."""
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        over = np.where(shift > 0, self.high[np.minimum(word + 1, len(self.high) - 1)] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        zeros = ~((self.high[word] >> shift) | over)
        return np.where(zeros == 0, 64, np.bitwise_count((zeros & (~zeros + np.uint64(1))) - np.uint64(1)).astype(np.int64))

    def seek(self, x: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first places in [start, stop) of a number not below x, else stop; and whether it is x."""
        x, start, stop = np.asarray(x, np.int64), np.asarray(start, np.int64), np.asarray(stop, np.int64)
        if not self.n or not len(x):
            return stop.copy(), np.zeros(len(x), bool)
        part = np.minimum(x >> self.width, self.top + 1)
        # numbers of a lower high part stand before its zero, those of the same are the ones behind it
        zero = np.where(part > 0, self._select(np.maximum(part - 1, 0), False), -1)
        first = zero - np.maximum(part - 1, -1)
        first = np.where(part > 0, first, 0)
        run = self._run(zero + 1)
        long = np.flatnonzero((run == 64) & (part <= self.top))
        if len(long):
            run[long] = self._select(part[long], False) - part[long] - first[long]
        end = first + np.where(part > self.top, 0, run)
        low, high = np.clip(first, start, stop), np.clip(end, start, stop)
        ends, rest = high.copy(), (x & ((1 << self.width) - 1)).astype(np.uint64)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = self._low(middle) < rest[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        same = (low < ends) & (low >= first)
        same[same] = self._low(low[same]) == rest[same]
        return low, same

    def successor(self, x: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The first places in [start, stop) of a number not below x, else stop."""
        return self.seek(x, start, stop)[0]


class Trie:
    """Distinct n-grams of one length, each with a byte: the words by level, the pointers to children, and the bytes of the last level."""

    def __init__(self, words: EliasFano, levels: list[tuple[EliasFano, EliasFano]], codes: np.ndarray) -> None:
        self.words, self.levels, self.codes = words, levels, codes

    @classmethod
    def of(cls, grams: np.ndarray, codes: np.ndarray) -> Trie:
        """grams (rows, length): in lexicographic order, none twice, of ids that are not negative."""
        names, local = numbered(grams.T)
        fresh, parent, levels = np.zeros(len(grams), bool), np.zeros(len(grams), np.int64), []
        for j in range(grams.shape[1]):
            if len(grams):
                fresh[0] = True
                fresh[1:] |= local[j, 1:] != local[j, :-1]
            rows = np.flatnonzero(fresh)
            of, ids = parent[rows], local[j, rows]
            begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(rows) else np.zeros(0, np.int64)
            ends = np.concatenate([begins[1:], [len(rows)]]) if len(rows) else begins
            base = np.concatenate([[0], np.cumsum(ids[ends - 1] + 1)[:-1]]) if len(rows) else begins
            levels.append((EliasFano.of(np.concatenate([begins, [len(rows)]])), EliasFano.of(ids + np.repeat(base, ends - begins))))
            parent = np.cumsum(fresh) - 1
        return cls(EliasFano.of(names), levels, np.asarray(codes, np.uint8))

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The places of n-grams in the last level, -1 where there is none. N-grams that follow one another with the same first words are looked up for these words once."""
        out = np.full(len(grams), -1, np.int64)
        if not len(self.codes):
            return out
        ids, which = numbered(grams.T)
        local, known = self.words.seek(ids, np.zeros(len(ids), np.int64), np.full(len(ids), self.words.n))
        local[~known] = -1
        for at in range(0, len(grams), AT_ONCE):
            some = local[which[:, at : at + AT_ONCE]]
            new = np.diff(which[:, at : at + AT_ONCE], prepend=-1) != 0
            fresh, node = new[0], np.zeros(some.shape[1], np.int64)
            for (pointers, values), own, changed in zip(self.levels, some, new, strict=True):
                fresh = fresh | changed
                heads = np.flatnonzero(fresh)
                above, begins = node[heads], np.flatnonzero(np.diff(node[heads], prepend=-2))
                # of each run of heads below one node: where its children stand
                run = np.cumsum(np.diff(above, prepend=-2) != 0) - 1
                parents = above[begins]
                there = np.flatnonzero(parents >= 0)
                start, stop, base = (np.zeros(len(parents), np.int64) for _ in range(3))
                start[there], stop[there] = pointers.at(parents[there]), pointers.at(parents[there] + 1)
                inner = there[start[there] > 0]
                base[inner] = values.at(start[inner] - 1) + 1
                word = own[heads]
                place = np.full(len(heads), -1, np.int64)
                asked = np.flatnonzero((word >= 0) & (above >= 0))
                below = run[asked]
                found, same = values.seek(base[below] + word[asked], start[below], stop[below])
                place[asked[same]] = found[same]
                node = place[np.cumsum(fresh) - 1]
            out[at : at + len(node)] = node
        return out

    def to_bytes(self) -> bytes:
        """One array after the other, each after its type and length, all at multiples of 8 bytes."""
        arrays = [np.array([len(self.levels)], np.int64), *self.words.arrays()]
        for pointers, values in self.levels:
            arrays += [*pointers.arrays(), *values.arrays()]
        out = io.BytesIO()
        for a in [*arrays, self.codes]:
            out.write(np.array([a.itemsize, len(a)], np.int64).tobytes())
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(b"\0" * (-out.tell() % 8))
        return out.getvalue()

    @classmethod
    def from_buffer(cls, data: np.ndarray) -> Trie:
        """The trie in bytes, which may be a mapped file: its arrays are views."""
        at = 0

        def take(kind: type) -> np.ndarray:
            nonlocal at
            size, n = data[at : at + 16].view(np.int64).tolist()
            found = data[at + 16 : at + 16 + size * n].view(kind)
            at += 16 + size * n + -(size * n) % 8
            return found

        def sequence() -> EliasFano:
            return EliasFano(take(np.int64), take(np.uint64), take(np.uint64), take(np.int64))

        n = int(take(np.int64)[0])
        words = sequence()
        return cls(words, [(sequence(), sequence()) for _ in range(n)], take(np.uint8))
