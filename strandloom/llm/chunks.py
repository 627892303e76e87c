"""Words of many texts at once: texts gathered to chunks, and distinct words with exact numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .common import slices
from .textvec import joined, mix, sequences

#: Bytes of text that a worker holds at a time (a longer text is a chunk of its own).
CHUNK_BYTES = 8 << 20
_OTHER = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B7F4A7C15))


def chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.Table]:
    """The rows in runs whose texts have about CHUNK_BYTES."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, text):
            held.append(part)
            size += part.column(text).nbytes
            if size >= CHUNK_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def runs(texts: list[bytes], inner: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs of inner bytes in joined texts: (data, start, length, text, piece, key, check).

    key and check are two hashes of a run's bytes. piece grows from one text to
    the next, and at each byte of `apart`, so that neighbours in one piece have neither between them.
    """
    data, at = joined(texts)
    parts = []
    edges = [0, *(np.flatnonzero(np.diff(at[:-1] >> 20)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:]):  # about a megabyte at a time, as the hashes of bytes are wide
        own = data[at[a] : at[b]]
        inside = inner[own]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        text = np.searchsorted(at[a : b + 1] - at[a], start, "right") - 1
        breaks = np.zeros(len(own), np.int64) if apart is None else apart[own].astype(np.int64)
        breaks[at[a + 1 : b + 1] - at[a] - 1] = 1
        key = mix(sequences(np.where(inside, own.astype(np.uint64) + np.uint64(1), np.uint64(0)), start))
        check = sequences(np.where(inside, _OTHER[own], np.uint64(0)), start)
        parts.append((start + at[a], end - start, text + a, np.cumsum(breaks)[start], key, check))
    base = 0
    for k, p in enumerate(parts):
        parts[k] = (*p[:3], p[3] + base, *p[4:])
        base = (parts[k][3][-1] if len(p[3]) else base) + 1
    if not parts:
        parts = [(*[np.zeros(0, np.int64)] * 4, *[np.zeros(0, np.uint64)] * 2)]
    return (data, *(np.concatenate(x) for x in zip(*parts)))


def distinct(key: np.ndarray, check: np.ndarray, spelled: Callable[[int], object]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each distinct word, every place's word number, counts).

    Words go by their key; should two of one key differ in their check, all go by their spelling.
    """
    _, first, number, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    if not (check[first][number] == check).all():
        seen: dict = {}
        number = np.fromiter((seen.setdefault(spelled(i), len(seen)) for i in range(len(key))), np.int64, len(key))
        _, first, counts = np.unique(number, return_index=True, return_counts=True)
    return first, number, counts


def spellings(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The given runs of bytes as one array."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    taken = data[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(taken))])
