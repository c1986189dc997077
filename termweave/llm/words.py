"""Hashes of all words of a text by array operations, for the operators on word windows.

A word's hash is a polynomial in random numbers of its bytes, scrambled: the difference of
two running sums, shifted to the word's start. Long texts are taken in pieces cut between
words, so memory stays small; hashes don't depend on the cuts.
"""

from __future__ import annotations

from functools import cache

import numpy as np

PIECE = 1 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))
BLANK = np.zeros(256, dtype=bool)
BLANK[list(b" \t\n\x0b\x0c\r")] = True
BYTES = np.random.default_rng(977).integers(0, 1 << 64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, FACTOR, dtype=np.uint64), np.full(size, INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(12, (n - 1).bit_length()))


def pieces(data: bytes) -> list[bytes]:
    """The data in pieces of about PIECE bytes, cut at white space (or nowhere, in a word)."""
    if len(data) <= PIECE:
        return [data]
    out, at = [], 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and not BLANK[data[end]]:
            end += 1
        out.append(data[at:end])
        at = end
    return out


def spans(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of an array of bytes."""
    full = np.zeros(len(a) + 2, dtype=np.int8)
    full[1:-1] = ~BLANK[a]
    edge = np.diff(full)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range."""
    up, down = powers(len(a) + 1)
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(BYTES[a] * up[: len(a)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """Hash of each word of a text."""
    out = []
    for piece in pieces(text.encode("utf-8", "surrogatepass")):
        a = np.frombuffer(piece, dtype=np.uint8)
        out.append(hashes(a, *spans(a)))
    return out[0] if len(out) == 1 else np.concatenate(out)
