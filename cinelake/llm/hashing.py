"""Vectorised hashes of byte ranges and of pairs of numbers."""

from __future__ import annotations

import numpy as np

#: Sums are prepared for so many bytes at least.
PREPARED = 1 << 21


class RollingHash:
    """Hashes of any byte range, from sums of byte values times powers of an odd base, modulo 2**64."""

    def __init__(self, seed: int) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.values = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1, 1 << 62)) * 8 + 5
        self.base, self.inverse = np.uint64(base % (1 << 64)), np.uint64(pow(base, -1, 1 << 64))
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        """Sums over the first i bytes, for each i."""
        if len(self.powers) <= len(data):
            n = max(len(data) + 1, PREPARED + 1)
            for name, factor in (("powers", self.base), ("inverses", self.inverse)):
                out = np.full(n, factor, np.uint64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        return sums

    def range(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.inverses[start])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


# The primes of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


#: Numbers that are hashed at a time: their arrays stay in the cache.
RUN = 1 << 14


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What ``functions.xxhash64(a, b)`` gives for two columns of longs, of unsigned arrays."""
    out = np.empty(len(a), np.uint64)
    x, y = np.empty((2, min(len(a), RUN)), np.uint64)
    for at in range(0, len(a), RUN):
        h = out[at : at + RUN]
        x, y = x[: len(h)], y[: len(h)]
        for k, column in enumerate((a, b)):
            np.multiply(column[at : at + RUN], P2, x)
            _turn(x, 31, y)
            np.multiply(x, P1, x)
            if k:
                np.add(h, P5 + np.uint64(8), h)
                np.bitwise_xor(h, x, h)
            else:
                np.bitwise_xor(x, np.uint64(42) + P5 + np.uint64(8), h)
            _turn(h, 27, y)
            np.multiply(h, P1, h)
            np.add(h, P4, h)
            for shift, prime in ((33, P2), (29, P3), (32, None)):
                np.right_shift(h, np.uint64(shift), y)
                np.bitwise_xor(h, y, h)
                if prime is not None:
                    np.multiply(h, prime, h)
    return out


def _turn(x: np.ndarray, by: int, room: np.ndarray) -> None:
    """Turn the bits of numbers, in place."""
    np.right_shift(x, np.uint64(64 - by), room)
    np.left_shift(x, np.uint64(by), x)
    np.bitwise_or(x, room, x)
