"""SetSketch: registers with exponentially spaced truncated minima.

Register i of a set is ``clip(floor(1 - log_B(min over the elements of an exponential variable of rate A)), 0, 255)``. Sketches
merge by maximum, and equal registers are likely for similar sets, so that bands of register values find candidates.
With the known set sizes, the similarity of two sets is estimated jointly from how many registers are larger on the one
side, larger on the other side, and equal.
"""

from __future__ import annotations

import numpy as np

from alertlake.llm.shingles import mix

B, A = 1.1, 20.0
ROWS, BANDS = 7, 32
REGISTERS = ROWS * BANDS
# A pair at the threshold shares no band with this probability at most; lower thresholds take bands of fewer rows for it.
MISS = 1e-5
# Elements hashed at a time, to stay in the processor's cache.
BLOCK = 1 << 15

_RNG = np.random.default_rng(19)
_FACTOR = _RNG.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_BAND = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64).reshape(BANDS, ROWS) * np.uint64(2) + np.uint64(1)


def sketch_sets(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers per set of 64-bit hashes; an empty set has registers of 0."""
    out = np.zeros((len(sets), REGISTERS), np.uint8)
    sizes = np.array([len(x) for x in sets])
    order, start = np.flatnonzero(sizes), 0
    while start < len(order):
        stop, size = start, 0
        while stop < len(order) and (size == 0 or size + sizes[order[stop]] <= BLOCK):
            size += sizes[order[stop]]
            stop += 1
        chosen, start = order[start:stop], stop
        if len(chosen) == 1:
            out[chosen[0]] = registers(minima(sets[chosen[0]]))
            continue
        low = (np.concatenate([sets[i] for i in chosen]) >> np.uint64(32)).astype(np.uint32)
        bounds = np.concatenate([[0], sizes[chosen].cumsum()[:-1]])
        least = np.empty((REGISTERS, len(chosen)), np.uint32)
        for k in range(REGISTERS):
            np.minimum.reduceat(low * _FACTOR[k] + _SHIFT[k], bounds, out=least[k])
        out[chosen] = registers(least.T)
    return out


def minima(elements: np.ndarray) -> np.ndarray:
    """Least hash per register of one set of any size, block by block."""
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for start in range(0, len(elements), BLOCK):
        low = (elements[start : start + BLOCK] >> np.uint64(32)).astype(np.uint32)
        for k in range(REGISTERS):
            least[k] = min(least[k], (low * _FACTOR[k] + _SHIFT[k]).min())
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """A uniform minimum becomes an exponential variable, and that a truncated register value."""
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / A
    return np.clip(np.floor(1 - np.log(value) / np.log(B)), 0, 255).astype(np.uint8)


def band_keys(sketches: np.ndarray, width: int = ROWS) -> np.ndarray:
    """One number per set and band of ``width`` registers; registers that fill no band are left over."""
    bands = REGISTERS // width
    rows = sketches.reshape(-1, REGISTERS)[:, : bands * width].reshape(-1, bands, width).astype(np.uint64)
    factors = _BAND.ravel()[: bands * width].reshape(bands, width)
    return mix((rows * factors).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def share(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)


def miss(similarity: float, width: int) -> float:
    """Probability that two sets of equal size share no band of ``width`` registers."""
    equal = 1 - 2 * float(share(np.array((1 - similarity) / 2)))
    return (1 - equal**width) ** (REGISTERS // width)


def band_width(similarity: float) -> int:
    """Registers per band: the most, up to ``ROWS``, that find a pair of this similarity with all but ``MISS``."""
    return next((width for width in range(ROWS, 1, -1) if miss(similarity, width) <= MISS), 1)


def slope(similarity: float, larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Derivative of the joint log-likelihood in the similarity; ``u`` is the first set's part of both sizes together.

    The likelihood is concave, so the estimate is at least ``similarity`` where the slope there is not negative.
    """
    v = 1 - u
    x, y = np.maximum(u - v * similarity, 0), np.maximum(v - u * similarity, 0)
    up, down = np.maximum(share(x), 1e-9), np.maximum(share(y), 1e-9)
    steep = (B - 1) / B / np.log(B)
    d_up, d_down = -v * steep / (1 - x * (B - 1) / B), -u * steep / (1 - y * (B - 1) / B)
    same = np.maximum(1 - up - down, 1e-9)
    return larger * d_up / up + smaller * d_down / down - equal * (d_up + d_down) / same


def compare(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of larger, smaller and equal registers along the last axis."""
    larger, smaller = (left > right).sum(axis=-1), (left < right).sum(axis=-1)
    return larger, smaller, left.shape[-1] - larger - smaller


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, steps: int = 30) -> np.ndarray:
    """Similarity of most likelihood, by bisection of the slope."""
    counts = compare(left, right)
    u = n_left / np.maximum(n_left + n_right, 1)
    low = np.zeros(u.shape)
    high = np.minimum(u, 1 - u) / np.maximum(np.maximum(u, 1 - u), 1e-12)
    top = high.copy()
    for _ in range(steps):
        middle = (low + high) / 2
        rising = slope(middle, *counts, u) > 0
        low, high = np.where(rising, middle, low), np.where(rising, high, middle)
    return np.minimum((low + high) / 2, top)
