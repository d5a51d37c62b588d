"""Vectorised 64-bit hashes of the words of texts."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes of text hashed at a time.
GROUP = 1 << 20

U64 = np.uint64
MUL = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_BYTE = np.frombuffer(hashlib.shake_256(b"byte values").digest(256 * 8), "<u8")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd number and of its inverse, modulo 2^64."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)])) for b in self.bases)
        return self.up[:n], self.down[:n]


class WordHasher:
    """Hashes of words: sums of byte values times powers, modulo 2^64, then mixed."""

    def __init__(self) -> None:
        self.bytes = Powers(0x2545F4914F6CDD1D)

    def word_hashes(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first byte) of every word of ``raw``, in pieces cut at white space."""
        hashes, firsts = [], []
        at = 0
        while at < len(raw):
            to = min(len(raw), at + GROUP)
            while to < len(raw) and not _SPACE[raw[to]]:
                to += 1
            b = np.frombuffer(raw, np.uint8, to - at, at)
            inside = np.concatenate([[False], ~_SPACE[b], [False]])
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            first, end = edge[::2], edge[1::2]
            if len(first):
                up, down = self.bytes.to(len(b) + 1)
                total = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE[b] * up[:-1])])
                hashes.append(mix((total[end] - total[first]) * down[first] + (end - first).astype(U64) * U64(MUL)))
                firsts.append(first + at)
            at = to
        if not hashes:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        return np.concatenate(hashes), np.concatenate(firsts)
