"""Word and shingle hashes over whole chunks of text, as NumPy arrays of unsigned 64-bit integers.

A word's hash is a polynomial over random byte codes modulo 2**64, mixed at the end; two different words share one with
a probability of about 2**-64. Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower case.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240917))
_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_rng.integers(1, 2**62)) * 4 + 5
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def wrap(x: int) -> np.uint64:
    return U(x & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64 bits (xor-shifts and odd multipliers)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def words(texts: list[str], separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text), in order. `separators` marks the bytes between words; 0x20 is one."""
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    buffer = np.frombuffer(b" ".join(data) + b" ", dtype=np.uint8)
    space = separators[buffer]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    n = len(buffer)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_CODES[buffer] * powers(_BASE, n), dtype=np.uint64, out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(_BASE_INVERSE, n)[starts]
    if n > 1 << 24:
        _powers.clear()
    hashes = mix(raw + (ends - starts).astype(np.uint64) * U(0x9E3779B97F4A7C15))
    lengths = np.fromiter((len(d) + 1 for d in data), dtype=np.int64, count=len(data))
    owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
    return hashes, owner


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words."""
    rolled = np.zeros(max(len(hashes) - width + 1, 0), dtype=np.uint64)
    for j in range(width):
        rolled += mix(hashes[j : j + len(rolled)] + wrap((j + 1) * 0xD1B54A32D192ED03)) * U(2 * j + 3)
    return mix(rolled)


def shingles(texts: list[str], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `width` words.

    A text of fewer words (but one at least) has its whole sequence as its only shingle; one without words has none.
    """
    hashes, owner = words(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    rolled = grams(hashes, width)
    out = []
    for k in range(len(texts)):
        a, b = int(bounds[k]), int(bounds[k + 1])
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = wrap((b - a) * 0xA0761D6478BD642F)
            parts = mix(hashes[a:b] + np.arange(1, b - a + 1, dtype=np.uint64) * U(0xE7037ED1A0B428DB))
            out.append(mix(np.array([wrap(int(parts.sum(dtype=np.uint64)) + int(whole))], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
