"""Hashes of words and word shingles of whole texts, equal in every process."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
# Texts are hashed in pieces of about this many bytes, cut at white space.
PIECE = 1 << 19

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = int(_RNG.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
_PLACE = _RNG.integers(0, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base & (2**64 - 1), dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def tables(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``count`` of them."""
    if len(_POWERS.get("up", ())) < count:
        size = max(count, 2 * PIECE)
        _POWERS["up"], _POWERS["down"] = powers(_BASE, size), powers(pow(_BASE, -1, 2**64), size)
    return _POWERS["up"], _POWERS["down"]


def pieces_of(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end before white space; only a longer word makes a longer piece."""
    at = 0
    while at < len(text):
        stop = at + PIECE
        while stop < len(text) and text[stop] not in b" \t\n\r\x0b\x0c":
            stop += 1
        yield text[at:stop]
        at = stop


def word_hashes(text: bytes) -> np.ndarray:
    """One number per word: a polynomial of its bytes, without regard to the case of A-Z."""
    found = []
    for piece in pieces_of(text):
        raw = np.frombuffer(piece, np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        start, stop = edge[0::2], edge[1::2]
        up, down = tables(len(raw) + 1)
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
        found.append(mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a shorter text is one shingle of all its words."""
    return shingles_of(word_hashes(text))


def shingles_of(words: np.ndarray) -> np.ndarray:
    """``shingle_set`` of a text of which the word hashes are known."""
    if not len(words):
        return words
    if len(words) < WORDS:
        return mix(np.array([(words * _PLACE[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))], dtype=np.uint64))
    total = np.full(len(words) - WORDS + 1, WORDS, dtype=np.uint64)
    for k in range(WORDS):
        total += words[k : len(words) - WORDS + 1 + k] * _PLACE[k]
    return np.unique(mix(total))
