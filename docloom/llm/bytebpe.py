"""Byte-pair merges of many pre-tokens at once, with numpy.

Pre-tokens of about the same length are rows of one matrix of ids.  In each pass every row merges its
pair of the least rank, the leftmost of equal ones, until no row has a pair that the vocabulary
merges; that is the order in which the tokenizers library merges them.
"""

from __future__ import annotations

import json

import numpy as np

#: Longest pre-token in bytes, and the lengths up to which pre-tokens share a matrix.
LONGEST = 40
WIDTHS = (4, 6, 8, 10, 12, 16, 24, LONGEST)
#: Slots of the table of pairs, as a power of two.
SLOT_BITS = 19

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.int32(np.iinfo(np.int32).max)


def printed_bytes() -> dict[int, str]:
    """The alphabet of byte-level vocabularies: printable bytes stand for themselves, the others for characters from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {x: chr(x) for x in printed} | {x: chr(256 + k) for k, x in enumerate(y for y in range(256) if y not in printed)}


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of pool that begin at starts and have the sizes, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


class Merges:
    """The vocabulary and merges of a byte-level file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.byte_ids = np.array([vocab[c] for _, c in sorted(printed_bytes().items())], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.uint64)
        # a pair is in its slot, or, if the slot is taken, in a sorted list
        self.keys = np.full(1 << SLOT_BITS, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << SLOT_BITS, _NEVER)
        slots = self._slots(keys)
        first = np.unique(slots, return_index=True)[1]
        self.keys[slots[first]], self.ranks[slots[first]] = keys[first], first
        rest = np.setdiff1d(np.arange(len(keys)), first)
        self.crowded = np.zeros(1 << SLOT_BITS, bool)
        self.crowded[slots[rest]] = True
        order = rest[np.argsort(keys[rest], kind="stable")]
        self.more_keys, self.more_ranks = keys[order], order.astype(np.int32)

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; _NEVER where they don't merge (ids under 0 are none)."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        slots = self._slots(keys)
        out = np.where(self.keys[slots] == keys, self.ranks[slots], _NEVER)
        if len(self.more_keys):
            odd = np.flatnonzero(self.crowded[slots] & (out == _NEVER))
            at = np.minimum(np.searchsorted(self.more_keys, keys[odd]), len(self.more_keys) - 1)
            out[odd] = np.where(self.more_keys[at] == keys[odd], self.more_ranks[at], _NEVER)
        return out

    def _merge(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Merges the rows of ids in place; sizes become the numbers of ids left."""
        width = ids.shape[1]
        if width < 2:
            return
        ranks = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width - 1)
        rows, now, columns = np.arange(len(ids)), ids, np.arange(width)
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(ranks)), at]
            going = best != _NEVER
            if not going.all():
                ids[rows[~going]] = now[~going]
                rows, now, ranks, at, best = rows[going], now[going], ranks[going], at[going], best[going]
            if not len(rows):
                return
            each = np.arange(len(rows))
            # what is right of the merged pair moves one place to the left
            later = columns[None, :] > at[:, None]
            now = np.where(later[:, :], np.concatenate([now[:, 1:], np.full((len(now), 1), -1, np.int32)], 1), now)
            ranks = np.where(later[:, : width - 1], np.concatenate([ranks[:, 1:], np.full((len(ranks), 1), _NEVER)], 1), ranks)
            now[each, at] = new = self.merged[best]
            sizes[rows] -= 1
            after = now[each, np.minimum(at + 1, width - 1)]
            found = self._ranks(new, np.where(at + 1 < width, after, -1))
            inner = at < width - 1
            ranks[each[inner], at[inner]] = found[inner]
            left = np.flatnonzero(at)
            ranks[left, at[left] - 1] = self._ranks(now[left, at[left] - 1], new[left])

    def encode(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens that lie in data (bytes) at starts, one after another, and their numbers; none may be over LONGEST."""
        counts = sizes.astype(np.int64)
        held = np.full((0, 0), -1, np.int32)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        least = 0
        for width in WIDTHS:
            own = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            if not len(own):
                continue
            inside = np.arange(width)[None, :] < sizes[own, None]
            held = np.full((len(own), width), -1, np.int32)
            held[inside] = self.byte_ids[gathered(data, starts[own], sizes[own])]
            left = counts[own]
            self._merge(held, left)
            counts[own] = left
            parts.append((own, held[np.arange(width)[None, :] < left[:, None]]))
        out = np.empty(int(counts.sum()), np.int32)
        begins = np.cumsum(counts) - counts
        for own, found in parts:
            n = counts[own]
            out[np.arange(len(found)) + np.repeat(begins[own] - (np.cumsum(n) - n), n)] = found
        return out, counts
