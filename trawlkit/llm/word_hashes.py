"""Hashes of the words of many texts at once, over one array of bytes."""

from __future__ import annotations

from functools import cache

import numpy as np

BASE = 0x100000001B3
MASK = (1 << 64) - 1


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64, and of its inverse."""
    up, down = np.full(1 << bits, BASE, np.uint64), np.full(1 << bits, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    bits = max(16, (size - 1).bit_length())
    up, down = _powers(bits) if bits <= 22 else _powers.__wrapped__(bits)
    return up[:size], down[:size]


def mixed(values: np.ndarray) -> np.ndarray:
    """Each 64-bit value scattered over the whole range."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def byte_table(chosen: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chosen, np.uint8)] = True
    return table


WHITE = byte_table(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(texts: list[bytes], ends: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word, and the number of the text it stands in.

    A-Z count as a-z; the bytes marked in `ends` part words, and so do the ends of texts.
    """
    joined = b" ".join(texts) + b" "
    codes = LOWER[np.frombuffer(joined, np.uint8)]
    gap = ends[codes]
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    last = np.cumsum(lengths + 1) - 1  # where the space behind each text stands
    gap[last] = True
    inside = ~gap
    begins = np.flatnonzero(inside & np.concatenate([[True], gap[:-1]]))
    stops = np.flatnonzero(gap & np.concatenate([[False], inside[:-1]]))
    up, down = powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    found = (sums[stops] - sums[begins]) * down[begins]
    return mixed(found ^ (stops - begins).astype(np.uint64)), np.searchsorted(last, begins)
