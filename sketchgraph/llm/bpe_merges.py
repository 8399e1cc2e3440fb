"""Merge tables of byte pair encodings.

A sequence of tokens is the encoding of its text if and only if each pair of neighbours is stable: merging
the parts of the two never crosses their border. So the last token of each prefix follows from the prefixes
before it, which is what the transducer of `token_counts` and the relaxation of `sentencepiece_codec` use.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Rank of tokens that no merge makes.
BASE = -1
FILTER_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class MergeTable:
    """rank: of the merge that makes a token, lower first. left, right: the two parts, the token itself if it is a base."""

    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray  # left * size + right, ascending
    pair_ranks: np.ndarray
    known: dict = field(default_factory=dict, repr=False)
    _lookup: dict | None = field(default=None, repr=False)
    _filter: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "_lookup": None, "_filter": None}

    @classmethod
    def of(cls, size: int, merges: dict[tuple[int, int], int], parts: dict[int, tuple[int, int]], ranks: dict[int, int]) -> MergeTable:
        """merges: rank by pair; parts and ranks: by merged token."""
        rank, own = np.full(size, BASE, np.int64), np.arange(size, dtype=np.int64)
        left, right = own.copy(), own.copy()
        for t, (a, b) in parts.items():
            rank[t], left[t], right[t] = ranks[t], a, b
        keys = np.fromiter((a * size + b for a, b in merges), np.int64, len(merges))
        values = np.fromiter(merges.values(), np.int64, len(merges))
        order = np.argsort(keys)
        return cls(rank, left, right, keys[order], values[order])

    @property
    def size(self) -> int:
        return len(self.rank)

    def made(self, token: int) -> bool:
        """Whether the encoding of a token's own text is that token."""
        if self.rank[token] == BASE:
            return True
        a, b = int(self.left[token]), int(self.right[token])
        return self._stable(a, b, 2 * int(self.rank[token])) and self.made(a) and self.made(b)

    def stable(self, a: int, b: int) -> bool:
        """Whether token b may follow token a."""
        if (got := self.known.get((a, b))) is None:
            got = self.known[a, b] = self._stable(a, b, 1 << 62)
        return got

    def _stable(self, a: int, b: int, bound: int) -> bool:
        if self._lookup is None:
            self._lookup = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist()))
            self._lists = self.rank.tolist(), self.left.tolist(), self.right.tolist()
        (rank, left, right), n, lookup = self._lists, self.size, self._lookup
        x, y = a, b
        # Undo the younger merge of the two sides; a pair across the border that would come before it breaks it.
        while True:
            crossing = lookup.get(x * n + y)
            if crossing is not None and 2 * crossing < bound:
                return False
            if rank[x] > rank[y]:
                bound, x = 2 * rank[x], right[x]
            elif rank[y] != BASE:
                bound, y = 2 * rank[y] + 1, left[y]
            else:
                return True

    def stable_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """stable() for arrays."""
        if self._filter is None:
            self._filter = np.zeros(1 << FILTER_BITS, bool)
            self._filter[self._slot(self.pair_keys)] = True
        out = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        bound = np.full(len(a), 1 << 62, np.int64)
        while len(at):
            keys = x * self.size + y
            hit = np.flatnonzero(self._filter[self._slot(keys)])
            place = np.minimum(np.searchsorted(self.pair_keys, keys[hit]), len(self.pair_keys) - 1)
            broken = hit[(self.pair_keys[place] == keys[hit]) & (2 * self.pair_ranks[place] < bound[hit])]
            out[at[broken]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_x = rx > ry
            more = undo_x | (ry != BASE)
            more[broken] = False
            bound = np.where(undo_x, 2 * rx, 2 * ry + 1)[more]
            x, y, at = np.where(undo_x, self.right[x], x)[more], np.where(undo_x, y, self.left[y])[more], at[more]
        return out

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
