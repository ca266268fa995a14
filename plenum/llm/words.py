"""Words of many texts at once, as arrays: where they stand, a hash of each, and tables of them that hashes index."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes in lower case, bytes as they are, and which are white space. Words up to LONG bytes are hashed together.
LOWER, AS_IS = np.array([c + 32 if 65 <= c < 91 else c for c in range(256)], np.uint8), np.arange(256, dtype=np.uint8)
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LONG = 256


def cut(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, A-Z in lower case if asked, one after another; their words' starts and sizes; words by text."""
    low = (LOWER if lower else AS_IS)[np.frombuffer(b"\n".join(texts) + b"\n" + bytes(8), np.uint8)]
    blank = BLANK[low[:-8]]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    return low, starts, ends - starts, np.diff(np.searchsorted(starts, edges))


def hashes(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time for all words that have them."""
    eight = np.lib.stride_tricks.as_strided(low[: max(len(low) - 7, 1)].view(np.uint8), (len(low) - 7, 8), (1, 1))
    out = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    open_ = np.flatnonzero(sizes <= LONG)
    for at in range(0, LONG, 8):
        if not len(open_):
            break
        word = np.ascontiguousarray(eight[starts[open_] + at]).view("<u8")[:, 0]
        short = np.minimum(8 - np.minimum(sizes[open_] - at, 8), 7).astype(np.uint64) * np.uint64(8)
        h = (out[open_] ^ (word << short)) * np.uint64(0xBF58476D1CE4E5B9)
        out[open_] = h ^ h >> np.uint64(29)
        open_ = open_[sizes[open_] > at + 8]
    for k in np.flatnonzero(sizes > LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(low[starts[k] : starts[k] + sizes[k]].tobytes(), 1)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ out >> np.uint64(31)


def same(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each word of one buffer has the bytes of that of another; both buffers end with eight spare bytes."""
    out = sizes == lengths
    open_ = np.flatnonzero(out & (sizes <= LONG))
    left, right = (np.lib.stride_tricks.as_strided(x, (max(len(x) - 7, 0), 8), (1, 1)) for x in (low, other))
    for at in range(0, LONG, 8):
        if not len(open_):
            break
        differs = np.ascontiguousarray(left[starts[open_] + at]).view("<u8")[:, 0] ^ np.ascontiguousarray(right[places[open_] + at]).view("<u8")[:, 0]
        short = np.minimum(8 - np.minimum(sizes[open_] - at, 8), 7).astype(np.uint64) * np.uint64(8)
        equal = differs << short == 0
        out[open_[~equal]] = False
        open_ = open_[equal & (sizes[open_] > at + 8)]
    for k in np.flatnonzero(out & (sizes > LONG)).tolist():
        out[k] = np.array_equal(low[starts[k] : starts[k] + sizes[k]], other[places[k] : places[k] + sizes[k]])
    return out


def distinct(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different words: where each stands first, and the number of each word's; hashes find them and bytes decide."""
    _, first, place = np.unique(own, return_index=True, return_inverse=True)
    odd = np.flatnonzero(~same(low, starts, sizes, low, starts[first][place], sizes[first][place]))
    names: dict[bytes, int] = {}
    for k in odd.tolist():
        place[k] = names.setdefault(low[starts[k] : starts[k] + sizes[k]].tobytes(), len(first) + len(names))
    more = np.zeros(len(names), np.int64)
    more[place[odd][::-1] - len(first)] = odd[::-1]
    return np.concatenate([first, more]), place


class WordTable:
    """Numbers 0, 1, ... of different words, found by a 64-bit hash in an open table of 2 ** bits slots and compared by their bytes.

    At most half of the slots may be used. Of words that share a hash only the first is kept.
    """

    def __init__(self, bits: int, most: int):
        self.bits, self.size, self.used = bits, 0, 0
        self.held, self.number = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.text, self.start, self.length = np.zeros(1 << 20, np.uint8), np.zeros(most, np.int64), np.zeros(most, np.int32)

    def _slot(self, own: np.ndarray) -> np.ndarray:
        return (own >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, own: np.ndarray, words: list[bytes]) -> None:
        """Number new words by their hashes, which must be different and not be here yet."""
        text = b"".join(words)
        while self.used + len(text) + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.text[self.used : self.used + len(text)] = np.frombuffer(text, np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        at = slice(self.size, self.size + len(words))
        self.start[at], self.length[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(text)
        left, slot = np.arange(len(own)), self._slot(own)
        while len(left):
            free = left[self.number[slot[left]] < 0]
            self.number[slot[free]] = free + self.size
            self.held[slot[free]] = own[free]
            left = left[self.number[slot[left]] != left + self.size]
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
        self.size += len(own)

    def find(self, own: np.ndarray, low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of words, -1 for those that are not here."""
        slot = self._slot(own)
        number = self.number[slot]
        out = np.where((number >= 0) & (self.held[slot] == own), number, -1).astype(np.int64)
        open_ = np.flatnonzero((out < 0) & (number >= 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & (1 << self.bits) - 1
            number = self.number[slot[open_]]
            met = (self.held[slot[open_]] == own[open_]) & (number >= 0)
            out[open_[met]] = number[met]
            open_ = open_[~met & (number >= 0)]
        here = np.flatnonzero(out >= 0)
        good = same(low, starts[here], sizes[here], self.text, self.start[out[here]], self.length[out[here]].astype(np.int64))
        out[here[~good]] = -1
        return out

    def holds(self, own: np.ndarray) -> np.ndarray:
        """Whether a hash is taken, by whichever word."""
        slot, out = self._slot(own), np.zeros(len(own), bool)
        open_ = np.arange(len(own))
        while len(open_):
            number = self.number[slot[open_]]
            out[open_] = (number >= 0) & (self.held[slot[open_]] == own[open_])
            open_ = open_[(number >= 0) & ~out[open_]]
            slot[open_] = slot[open_] + 1 & (1 << self.bits) - 1
        return out
