"""Hashes of words and byte n-grams for many texts at once, as numpy arrays."""

from __future__ import annotations

import functools

import numpy as np

#: Odd, so that no power of it loses bits modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BLANKS = b" \t\n\v\f\r"


@functools.cache
def _powers(n: int) -> np.ndarray:
    """The first n powers of BASE."""
    p = np.full(n, BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def sequences(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of each run of values; a run goes from its start to the next one's."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = np.diff(start, append=len(values))
    offset = np.arange(start[0], len(values)) - np.repeat(start, length)
    power = _powers(1 << max(6, int(length.max()).bit_length()))
    return np.add.reduceat(values[start[0] :] * power[offset], start - start[0])


@functools.cache
def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


@functools.cache
def _blank() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(BLANKS)] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, a space behind each, and where each text begins (one more entry: the end)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts


def words(texts: list[bytes], lower: bool = True, inner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space: their hashes, byte starts and ends, and (one more than texts) where each text's words begin.

    inner: a mark for each byte that words are made of, where it isn't all but white space.
    """
    data, at = joined(texts)
    if lower:
        data = _lower()[data]
    inside = ~_blank()[data] if inner is None else inner[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = mix(sequences(np.where(inside, data.astype(np.uint64) + np.uint64(1), np.uint64(0)), start))
    return hashes, start, end, np.searchsorted(start, at)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row, and where each text's begin.

    A text of fewer words, but at least one, has its whole sequence as its only one.
    """
    count = np.diff(first)
    many = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(many, out=out_first[1:])
    text = np.repeat(np.arange(len(count)), many)
    begin = first[:-1][text] + (np.arange(out_first[-1]) - out_first[:-1][text])
    length = np.minimum(count, n)[text]
    total = np.zeros(len(begin), np.uint64)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    for k in range(n):
        factor = np.uint64(pow(int(BASE), k + 1, 1 << 64))
        total += np.where(length > k, mix(padded[begin + k] + np.uint64(k)) * factor, np.uint64(0))
    return mix(total + length.astype(np.uint64)), out_first
