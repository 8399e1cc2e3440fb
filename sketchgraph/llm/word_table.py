"""A numpy table from words to numbers, for what a worker remembers of words it has met.

Words are spans of an array of code points. A span's key is a polynomial hash modulo 2**64, taken from running
sums, so that no string is made for a word that is known. The code points of each word are kept and compared with those
of a span that has its key; a span whose key another word has is encoded each time, and so is one over `LONGEST` points.
"""

from __future__ import annotations

import numpy as np

LONGEST = 200
_ODD, _MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    while len(have) < n:
        base = _ODD if kind == "up" else _INVERSE
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[kind] = have
    return have


def span_keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of spans, never 0."""
    wide = (points.astype(np.uint64) + np.uint64(1)) * _MIX
    wide ^= wide >> np.uint64(29)
    wide *= _power("up", len(points) + 1)[: len(points)]
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(wide, out=total[1:])
    out = (total[ends] - total[starts]) * _power("down", len(points) + 1)[starts]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out | np.uint64(1)


class WordTable:
    """Keys and the numbers 0, 1, ... in the order in which they were added."""

    def __init__(self, bits: int = 16):
        self.n = 0
        self._empty(bits)

    def _empty(self, bits: int) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers, -1 for keys that aren't here."""
        at = (keys >> self.shift).astype(np.int64)
        got = self.keys[at]
        out = np.where(got == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((got != keys) & (got != 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            got = self.keys[at[left]]
            same = got == keys[left]
            out[left[same]] = self.values[at[left[same]]]
            left = left[~same & (got != 0)]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of new, distinct keys."""
        numbers = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        if 2 * self.n > self.mask:
            bits, old, values = (2 * self.n).bit_length() + 1, self.keys, self.values
            self._empty(bits)
            self._put(old[old != 0], values[old != 0])
        self._put(keys, numbers)
        return numbers

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = (keys >> self.shift).astype(np.int64)
        while len(keys):  # of those that want a slot the first gets it, the others go on
            one = np.zeros(len(at), bool)
            one[np.unique(at, return_index=True)[1]] = True
            one &= self.keys[at] == 0
            self.keys[at[one]], self.values[at[one]] = keys[one], values[one]
            keys, values, at = keys[~one], values[~one], (at[~one] + 1) & self.mask


class WordMemo:
    """The ids of words, each word encoded once. Words over LONGEST are encoded each time."""

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.words = WordTable()
        self.flat, self.ends = np.zeros(1 << 20, np.int32), np.zeros(1 << 18, np.int64)
        self.chars, self.char_ends = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64)

    def _remember(self, ids: np.ndarray, counts: np.ndarray, chars: np.ndarray, lengths: np.ndarray) -> None:
        n = self.words.n
        while n + len(counts) >= len(self.ends):
            self.ends, self.char_ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ends, self.char_ends))
        for flat, ends, values, sizes in (("flat", self.ends, ids, counts), ("chars", self.char_ends, chars, lengths)):
            used = ends[n]
            while used + len(values) > len(getattr(self, flat)):
                setattr(self, flat, np.concatenate([getattr(self, flat), np.zeros_like(getattr(self, flat))]))
            getattr(self, flat)[used : used + len(values)] = values
            ends[n + 1 : n + 1 + len(sizes)] = used + np.cumsum(sizes)

    def _others(self, at: np.ndarray, points: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which spans are not the words of these numbers."""
        known = at >= 0
        differ = known & (self.char_ends[at + 1] - self.char_ends[at] != lengths)
        mine = np.flatnonzero(known & ~differ)
        sizes = lengths[mine]
        start = np.cumsum(sizes) - sizes
        step = np.arange(int(sizes.sum()), dtype=np.int64)
        wrong = np.flatnonzero(self.chars[step + np.repeat(self.char_ends[at[mine]] - start, sizes)] != points[step + np.repeat(begins[mine] - start, sizes)])
        differ[mine[np.searchsorted(start, wrong, side="right") - 1]] = True
        return np.flatnonzero(differ)

    def ids(self, points: np.ndarray, begins: np.ndarray, ends: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at begins:ends in one array, and where each word's ids begin in it (and the last ones end).

        encode(begins, ends) gives the ids of words in one array, and their numbers.
        """
        if self.words.n > self.most:
            self.forget()
        keys, lengths = span_keys(points, begins, ends), ends - begins
        at = self.words.find(keys).astype(np.int64)
        if len(missing := np.flatnonzero((at < 0) & (lengths <= LONGEST))):
            new, first, place = np.unique(keys[missing], return_index=True, return_inverse=True)
            first = missing[first]
            spread = np.arange(int(lengths[first].sum())) + np.repeat(begins[first] - np.cumsum(lengths[first]) + lengths[first], lengths[first])
            self._remember(*encode(begins[first], ends[first]), points[spread], lengths[first])
            at[missing] = self.words.add(new)[place]
        at[self._others(at, points, begins, lengths)] = -1
        once = np.flatnonzero(at < 0)
        n, known = np.zeros(len(at), np.int64), at >= 0
        n[known] = self.ends[at[known] + 1] - self.ends[at[known]]
        if len(once):
            own, n[once] = encode(begins[once], ends[once])
        total = np.zeros(len(at) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        source = np.repeat(np.where(known, self.ends[at], 0) - total[:-1], n) + np.arange(total[-1])
        if len(once):
            out = np.empty(total[-1], np.int32)
            mine = np.repeat(known, n)
            out[mine], out[~mine] = self.flat[source[mine]], own
        else:
            out = self.flat[source]
        return out, total
