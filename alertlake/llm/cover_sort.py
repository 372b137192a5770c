"""Blockwise suffix sorting with a difference cover, as far as a fixed depth.

The cover {0, 1, 3, 9} modulo 13 meets every difference: for any two positions there is a shift below 13 that brings both
to covered positions. Covered suffixes are ranked once, to ``DEPTH`` bytes, by doubling over the period. All other
suffixes are sorted one bucket at a time by their first 16 bytes; ties go on by comparing the ranks at the common shift,
so that no comparison reads further text, and memory is bounded by the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PERIOD, COVER = 13, (0, 1, 3, 9)
DEPTH = 4 * PERIOD
# Suffixes sorted at a time.
BUCKET = 1 << 19

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
SHIFT = np.array([[next(d for d in range(PERIOD) if _IN_COVER[(a + d) % PERIOD] and _IN_COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


class CoverRanks:
    """Ranks of the covered suffixes of a text, and common prefixes between ranks."""

    def __init__(self, text: np.ndarray):
        padded = np.concatenate([text, np.zeros(3 * DEPTH, np.uint8)])
        words = padded.astype(np.uint64)
        for width in (1, 2, 4):
            words = (words[:-width] << np.uint64(8 * width)) | words[width:]
        self.words = words  # eight bytes from each position, first byte highest
        places = np.arange(len(text) + DEPTH)
        self.places = places[_IN_COVER[places % PERIOD]]
        self.slot = np.full(len(text) + DEPTH, -1, np.int32)
        self.slot[self.places] = np.arange(len(self.places), dtype=np.int32)
        # PERIOD bytes: eight, and five more.
        name = names(words[self.places], words[self.places + 8] >> np.uint64(24))
        for reach in (PERIOD, 2 * PERIOD):
            beyond = self.places + reach
            later = np.where(beyond < len(self.slot), self.slot[np.minimum(beyond, len(self.slot) - 1)], -1)
            name = names((name.astype(np.uint64) << np.uint64(32)) | np.where(later >= 0, name[later] + 1, 0).astype(np.uint64))
        self.rank = name
        first = np.zeros(int(name.max(initial=-1)) + 1, np.int64)
        first[name] = self.places
        self.levels = [self.prefix(first[:-1], first[1:])]
        while 2 ** len(self.levels) <= len(self.levels[0]):
            step, last = 2 ** (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal leading bytes of the suffixes at a and b, ``DEPTH`` at most."""
        total, going = np.zeros(len(a), np.uint8), np.ones(len(a), dtype=bool)
        for at in range(0, DEPTH, 8):
            differ = self.words[np.minimum(a + at, len(self.words) - 1)] ^ self.words[np.minimum(b + at, len(self.words) - 1)]
            same = np.full(len(a), 8, np.uint8)
            for byte in range(8):
                same[(differ >> np.uint64(56 - 8 * byte)) & np.uint64(255) != 0] = np.minimum(same[(differ >> np.uint64(56 - 8 * byte)) & np.uint64(255) != 0], byte)
            total += np.where(going, same, 0).astype(np.uint8)
            going &= same == 8
        return np.minimum(total, DEPTH)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of two ranks: the least step between them, from a table of minima over powers of two."""
        low, high = np.minimum(a, b), np.maximum(a, b)
        span = high - low
        out = np.full(len(a), DEPTH, np.uint8)
        level = np.where(span > 0, np.frexp(np.maximum(span, 1))[1] - 1, -1)
        for k in np.unique(level[level >= 0]):
            some = level == k
            table = self.levels[k]
            out[some] = np.minimum(table[low[some]], table[high[some] - 2**k])
        return out


def names(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the rows of keys; the first key counts most."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), dtype=bool)
    for key in keys:
        ranked = key[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def buckets(words: np.ndarray, suffixes: np.ndarray) -> Iterator[np.ndarray]:
    """Suffixes by ranges of their first eight bytes, about ``BUCKET`` at a time; equal beginnings stay together."""
    if len(suffixes) <= BUCKET:
        yield suffixes
        return
    lead = words[suffixes]
    cuts = np.unique(np.quantile(lead.astype(np.float64), np.linspace(0, 1, len(suffixes) // BUCKET + 2)[1:-1]))
    group = np.searchsorted(cuts, lead.astype(np.float64), side="right")
    for k in range(len(cuts) + 1):
        chosen = suffixes[group == k]
        if len(chosen):
            yield chosen


def equal_classes(text: np.ndarray, suffixes: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffixes, class): groups of two or more suffixes that share their first ``length`` bytes, bucket by bucket.

    ``length`` is between 16 and ``DEPTH`` - 1.
    """
    if not 16 <= length < DEPTH:
        raise ValueError(f"length must be from 16 to {DEPTH - 1}")
    if len(suffixes) < 2:
        return
    cover = CoverRanks(text)
    for bucket in buckets(cover.words, suffixes):
        start = names(cover.words[bucket], cover.words[bucket + 8])
        order = np.argsort(start, kind="stable")
        members, group = bucket[order], start[order]
        next_class = 0
        while len(members):
            edge = np.flatnonzero(np.diff(group, prepend=-1, append=-1 if len(group) == 0 else group[-1] + 1))
            sizes = np.diff(edge)
            several = np.repeat(sizes > 1, sizes)
            members, group = members[several], group[several]
            if not len(members):
                break
            sizes = sizes[sizes > 1]
            begin = np.concatenate([[0], sizes.cumsum()[:-1]])
            pivot = np.repeat(members[begin + sizes // 2], sizes)
            shift = SHIFT[members % PERIOD, pivot % PERIOD]
            a, b = cover.rank[cover.slot[members + shift]], cover.rank[cover.slot[pivot + shift]]
            same = (shift + cover.common(a, b) >= length) | (members == pivot)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            count = np.bincount(owner[same], minlength=len(sizes))
            found = same & (count[owner] > 1)
            if found.any():
                yield members[found], owner[found] + next_class
            next_class += len(sizes)
            rest = ~same
            members, side = members[rest], 2 * owner[rest] + (a > b)[rest]
            order = np.argsort(side, kind="stable")
            members, group = members[order], side[order]
