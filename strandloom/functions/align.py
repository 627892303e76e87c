"""Alignments of short windows, vectorised over rows; alternates to the built-in edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Match, mismatch, opening and extending a gap.
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 2, 4, 4, 2
FAR = 10**8


def _matrix(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Rows of character codes, padded with 0, and their lengths."""
    size = texts.str.len().to_numpy(np.int64)
    out = np.zeros((len(texts), max(1, int(size.max(initial=0)))), np.int64)
    for row, text in zip(out, texts):
        row[: len(text)] = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return out, size


def edit_distance_pair(own: Column, ref: Column, alt: Column) -> Column:
    """(to_ref, to_alt): the edit distances of a read's window to the reference's and to that with the other base."""
    return F.struct(F.levenshtein(own, ref).cast("long").alias("to_ref"), F.levenshtein(own, alt).cast("long").alias("to_alt"))


def edit_distance_dp(a: Column, b: Column) -> Column:
    """Levenshtein's distance of whole texts; null if one is null."""
    return F.levenshtein(a, b).cast("long")


@F.pandas_udf(T.LongType())
def affine_gap_score(query: pd.Series, target: pd.Series) -> pd.Series:
    """The score of a global alignment with affine gaps that begins at the target's start; null if a text is null."""
    known = (query.notna() & target.notna()).to_numpy()
    x, n = _matrix(query[known])
    y, m = _matrix(target[known])
    rows, width = np.arange(len(x)), y.shape[1] + 1
    h = np.full((x.shape[1] + 1, len(x), width), -FAR, np.int64)
    e, f = h.copy(), h.copy()
    h[0, :, 0] = 0
    for i in range(1, x.shape[1] + 1):
        h[i, :, 0] = f[i, :, 0] = -GAP_OPEN - i * GAP_EXTEND
        for j in range(1, width):
            e[i, :, j] = np.maximum(h[i, :, j - 1] - GAP_OPEN, e[i, :, j - 1]) - GAP_EXTEND
            f[i, :, j] = np.maximum(h[i - 1, :, j] - GAP_OPEN, f[i - 1, :, j]) - GAP_EXTEND
            fit = np.where(x[:, i - 1] == y[:, j - 1], MATCH, -MISMATCH)
            h[i, :, j] = np.maximum(np.maximum(h[i - 1, :, j - 1] + fit, e[i, :, j]), f[i, :, j])
    out = pd.Series(np.full(len(query), None), dtype="Int64")
    out[known] = h[n, rows, m]
    return out


def _slices(*texts: pd.Series) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The two texts of a few rows at a time, as `_matrix` gives them, so that their tables have some 16 million cells at most (or are of one row)."""
    cells = ((texts[0].str.len().max() or 0) + 1) * ((texts[1].str.len().max() or 0) + 1) if len(texts[0]) else 1
    step = max(1, (1 << 24) // int(cells))
    for at in range(0, len(texts[0]), step):
        own = slice(at, at + step)
        yield own, *_matrix(texts[0].iloc[own]), *_matrix(texts[1].iloc[own])


def _walk_back(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(distance) first; then, from the ends of all rows' best alignments on, (place in x, place in y, whether they are a pair, a gap in x, a gap in y).

    Among equally good alignments a pair goes before a gap in x, and that before one in y.
    """
    rows = np.arange(len(x))
    table = np.zeros((len(x), x.shape[1] + 1, y.shape[1] + 1), np.int32)
    table[:, :, 0], table[:, 0, :] = np.arange(x.shape[1] + 1), np.arange(y.shape[1] + 1)
    for i in range(1, x.shape[1] + 1):
        for j in range(1, y.shape[1] + 1):
            table[:, i, j] = np.minimum(np.minimum(table[:, i - 1, j], table[:, i, j - 1]) + 1, table[:, i - 1, j - 1] + (x[:, i - 1] != y[:, j - 1]))
    i, j = n.copy(), m.copy()
    yield (table[rows, n, m],)
    while ((i > 0) | (j > 0)).any():
        now, before_i, before_j = table[rows, i, j], np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        pair = (i > 0) & (j > 0) & (now == table[rows, before_i, before_j] + (x[rows, before_i] != y[rows, before_j]))
        in_x = ~pair & (j > 0) & (now == table[rows, i, before_j] + 1)
        in_y = ~pair & ~in_x & (i > 0)
        i, j = i - (pair | in_y), j - (pair | in_x)
        yield i, j, pair, in_x, in_y


@F.pandas_udf(T.StructType([T.StructField("distance", T.LongType()), T.StructField("base", T.StringType())]))
def align_traceback(query: pd.Series, target: pd.Series, place: pd.Series) -> pd.DataFrame:
    """The edit distance, and the query's base that a place in the target aligns to, '-' if none; nulls if one is null."""
    known = (query.notna() & target.notna() & place.notna()).to_numpy()
    wanted = place[known].to_numpy(np.int64)
    distance, base = np.zeros(len(wanted), np.int64), np.full(len(wanted), ord("-"), np.int64)
    for own, x, n, y, m in _slices(query[known], target[known]):
        steps = _walk_back(x, n, y, m)
        (distance[own],) = next(steps)
        for i, j, pair, _, _ in steps:
            hit = pair & (j == wanted[own])
            base[own][hit] = x[np.flatnonzero(hit), i[hit]]
    out = pd.DataFrame({"distance": pd.array([None] * len(query), "Int64"), "base": pd.array([None] * len(query), object)})
    out.loc[known, "distance"] = distance
    out.loc[known, "base"] = [chr(b) for b in base]
    return out


@F.pandas_udf(T.StringType())
def show_alignment(query: pd.Series, target: pd.Series) -> pd.Series:
    """Three lines: the target, marks where both agree, and the query, with '-' for gaps. For reading only."""
    known = (query.notna() & target.notna()).to_numpy()
    shown: list[str] = []
    for _, x, n, y, m in _slices(query[known], target[known]):
        steps, rows = _walk_back(x, n, y, m), np.arange(len(x))
        next(steps)
        columns = []
        for i, j, pair, in_x, in_y in steps:
            own, other = np.where(in_x, ord("-"), x[rows, np.minimum(i, x.shape[1] - 1)]), np.where(in_y, ord("-"), y[rows, np.minimum(j, y.shape[1] - 1)])
            mark = np.where(pair & (own == other), ord("|"), ord(" "))
            columns.append(np.where(pair | in_x | in_y, [other, mark, own], 0))
        if not columns:
            shown += ["\n\n"] * len(x)
            continue
        for lines in np.stack(columns[::-1]).transpose(2, 1, 0):  # rows, lines, places
            shown.append("\n".join("".join(map(chr, line[lines[0] > 0])) for line in lines))
    out = pd.Series([None] * len(query), dtype=object)
    out[known] = shown
    return out
