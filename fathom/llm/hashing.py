"""64-bit hashes of ranges of bytes or words, all at once by prefix sums."""

from __future__ import annotations

import numpy as np

U = np.uint64

#: Bytes of texts that are hashed at once; a longer text goes alone.
HASH_BYTES = 1 << 18

#: ASCII white space, by byte value.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, U) | U(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


BYTE, _POWER = odd(1, 256), odd(2, 1)[0]
_INVERSE = U(pow(int(_POWER), -1, 1 << 64))
_UP, _DOWN = _powers(_POWER, HASH_BYTES + 64), _powers(_INVERSE, HASH_BYTES + 64)


def range_hashes(weights: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each range [first, end) of weights (uint64): equal for equal ranges, wherever they stand."""
    n = len(weights)
    up, down = (_UP, _DOWN) if n < len(_UP) else (_powers(_POWER, n + 1), _powers(_INVERSE, n + 1))
    sums = np.zeros(n + 1, U)
    np.cumsum(weights * up[:n], out=sums[1:])
    return mixed((sums[end] - sums[first]) * down[first] + (end - first).astype(U))
