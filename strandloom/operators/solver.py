"""The order-dependent passes over the k-mer graph, in stretches that share nothing.

Tips and bubbles change what later steps see, so they run in a fixed order, but
what one of them reads and writes lies near it. Tips are dealt out by runs of
branching ranks without a wide gap, bubbles by runs of areas whose reads overlap,
and several runs near each other are one task. Blocks are walks over buckets of ranks, and
only their bounds are needed to tell which of them join. Only the first and last rank of a
chromosome behave unlike others, and the task knows where they are. Local correction takes the
reads inside a block only; it runs in pieces of variants that read past their ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bubbles as _areas
from . import hints as _hints
from . import kmers as _kmers
from . import reads as _reads
from . import walks as _walks
from .stored import shuffled, stored

#: Lengths of short and long tips, the support a tip must lose by, paths that a bubble may have.
TIP_SHORT, TIP_LONG, TIP_SUPPORT, MOST_PATHS = 5, 15, 1.5, 256
#: The window of local correction, its patterns in the order they are tried, variants skipped behind a change.
WINDOW, PATTERNS, SKIP = 5, (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 24), 64
TIP_HINT, TANGLE_HINT = 2, 3
#: A tip at a rank reads edges from BEHIND ranks before it to AHEAD ranks after it, and takes those of 5 before it to 4 after it.
#: Tips run forward first and then backward: no tip sees another one that is more than 2 * APART ranks away.
BEHIND, AHEAD, APART = TIP_LONG + 2, TIP_LONG + 1, 11
#: Runs that begin within so many ranks are one task.
TASK = 1 << 12
#: Variants that a task of local correction corrects, and how many more before them it reads at first than reads and windows need.
PIECE, SLACK = 1 << 13, 1 << 10
STAGES = ("tips", "closed", "bubbles", "areas", "blocks", "hints", "joined", "shares")


class Island:
    """Nodes, edge weights, hints and reads of one island; ranks and variants count from its first."""

    def __init__(self, k: int, first: int, last: int, n_snp: int):
        self.k, self.first, self.n = k, first, last - first + 1
        self.mask, self.full = (1 << k) - 1, (1 << (k + 1)) - 1
        self.ranks = max(self.n - k + 1, 0)
        self.count = np.zeros((self.ranks + 1, 1 << k), np.int64)
        self.weight = np.zeros((self.ranks + 1, 2 << k), np.int64)
        #: Ranks of the chromosome's first and last node, as seen from here.
        self.start, self.end = -first, n_snp - k - first
        self.hint = np.zeros(self.n, np.int64)
        self.reads: list[tuple[int, np.ndarray]] = []  # first variant, alleles
        self.over: list[list[int]] = [[] for _ in range(self.n)]
        self.areas: list[tuple[int, int, int]] = []  # first and last variant, ways through
        self.closed = self.weight  # weights once all areas are closed
        self.pairs: list[int] | None = None  # the undecided variants, where the edges here don't tell them

    def add_read(self, snps: np.ndarray, alleles: np.ndarray) -> None:
        """A read's calls; variants that it skips are gaps."""
        row = np.full(snps[-1] - snps[0] + 1, -1, np.int64)
        row[snps - snps[0]] = alleles
        for s in range(snps[0], snps[-1] + 1):
            self.over[s - self.first].append(len(self.reads))
        self.reads.append((int(snps[0]) - self.first, row))

    # Edges by node and bit; forward leads to higher ranks.

    def edge(self, s: int, w: int, bit: int, forward: bool) -> tuple[int, int]:
        return (s, w << 1 | bit) if forward else (s - 1, bit << self.k | w)

    def get(self, s: int, w: int, bit: int, forward: bool) -> int:
        if (s >= self.ranks - 1) if forward else (s <= 0):
            return 0
        return int(self.weight[self.edge(s, w, bit, forward)])

    def put(self, s: int, w: int, bit: int, forward: bool, value: int) -> None:
        rank, e = self.edge(s, w, bit, forward)
        self.weight[rank, e] = self.weight[rank, self.full - e] = value

    def degree(self, s: int, w: int, forward: bool) -> int:
        return (self.get(s, w, 0, forward) > 0) + (self.get(s, w, 1, forward) > 0)

    def step(self, s: int, w: int, bit: int, forward: bool) -> tuple[int, int]:
        return (s + 1, (w << 1 | bit) & self.mask) if forward else (s - 1, (bit << self.k | w) >> 1)

    # Tips.

    def remove_tips(self) -> None:
        # Edges only go, so that no node begins to branch.
        both = (self.weight[:, 0::2] > 0) & (self.weight[:, 1::2] > 0)
        for s, w in sorted(np.argwhere(both[:, : 1 << (self.k - 1)]).tolist(), key=lambda n: (-n[0], n[1])):
            self._tip(s, w, True)
        both = (self.weight[:, : 1 << self.k] > 0) & (self.weight[:, 1 << self.k :] > 0)
        for s, w in np.argwhere(both[:, : 1 << (self.k - 1)]).tolist():
            self._tip(s + 1, w, False)
        live = np.zeros_like(self.count, bool)
        s, e = np.nonzero(self.weight[:-1] > 0)
        live[s, e >> 1] = live[s + 1, e & self.mask] = True
        self.count[~live] = 0

    def _measure(self, s: int, w: int, bit: int, forward: bool) -> tuple[bool, int]:
        """Whether the branch is a plain tip, and its length as far as it matters."""
        plain, length = True, 0
        s, w = self.step(s, w, bit, forward)
        while self._open(s, forward):
            if self.degree(s, w, not forward) == 2:
                plain = False
            a, b = self.get(s, w, 0, forward), self.get(s, w, 1, forward)
            if not a and not b:
                break
            if a and b:
                plain = False
            s, w = self.step(s, w, int(a <= b), forward)
            length += 1
            if length > TIP_LONG:
                break
        return plain, length

    def _open(self, s: int, forward: bool) -> bool:
        return s < self.end if forward else s > self.start

    def _support(self, s: int, w: int, bit: int, steps: int, forward: bool) -> int:
        total = self.get(s, w, bit, forward)
        s, w = self.step(s, w, bit, forward)
        for _ in range(steps):
            a, b = self.get(s, w, 0, forward), self.get(s, w, 1, forward)
            total += a if a > 0 else b
            s, w = self.step(s, w, int(a <= b), forward)
        return total

    def _tip(self, s: int, w: int, forward: bool) -> None:
        if self.degree(s, w, forward) != 2:
            return
        (plain0, n0), (plain1, n1) = self._measure(s, w, 0, forward), self._measure(s, w, 1, forward)
        gone = 1 if plain1 and n1 < TIP_SHORT and n0 > TIP_LONG else 0 if plain0 and n0 < TIP_SHORT and n1 > TIP_LONG else None
        if gone is None:
            return
        t0, t1 = (self._support(s, w, bit, min(n0, n1), forward) for bit in (0, 1))
        doubtful = plain0 and t1 < TIP_SUPPORT * t0 or plain1 and t0 < TIP_SUPPORT * t1
        if doubtful:
            self.hint[s] = TIP_HINT
        self.put(s, w, gone, forward, 0)
        s, w = self.step(s, w, gone, forward)
        while self._open(s, forward):
            if doubtful:
                self.hint[s] = TIP_HINT
            a, b = self.get(s, w, 0, forward), self.get(s, w, 1, forward)
            if not a and not b:
                break
            bit = int(a <= 0)
            self.put(s, w, bit, forward, 0)
            s, w = self.step(s, w, bit, forward)

    # Bubbles.

    def bubbles(self) -> Iterator[tuple[int, int, list[int]]]:
        """(first variant, last variant, reads) of each undecided area."""
        kinds = np.zeros(self.n + 1, np.int64)
        if self.pairs is not None:
            kinds[self.pairs] = 3
        for s, e in () if self.pairs is not None else np.argwhere(self.weight[:, : 1 << self.k] > 0).tolist():
            for j in range(1, self.k + 1):
                kinds[s + j] |= 1 if (e >> (self.k - j) & 1) == (e >> (self.k - j + 1) & 1) else 2
        now: tuple[int, int, set[int]] | None = None
        before = 0
        for s in np.flatnonzero(kinds == 3).tolist():
            own = set(self.over[s - 1]) & set(self.over[s])
            left = min((self.reads[r][0] for r in own), default=s)
            right = max((self.reads[r][0] + len(self.reads[r][1]) - 1 for r in own), default=s)
            if now and left > before:
                yield now[0], now[1], sorted(now[2])
                now = None
            now = (min(now[0], left), max(now[1], right), now[2] | own) if now else (left, right, own)
            before = s
        if now:
            yield now[0], now[1], sorted(now[2])

    def _close(self, left: int, right: int) -> None:
        """Give dead ends inside an area an edge to every node there is beside them."""
        for s in range(left, right - self.k + 2):
            for w in np.flatnonzero(self.count[s] > 0).tolist():
                for forward, may in ((False, s > left), (True, s + self.k - 1 < right)):
                    if may and self.degree(s, w, forward) == 0:
                        for bit in (0, 1):
                            if self.count[self.step(s, w, bit, forward)] > 0:
                                self.put(s, w, bit, forward, 1)

    def _paths(self, left: int, right: int) -> int:
        """Ways through an area up to complement, counted no further than twice the limit."""
        if right - left + 1 < self.k:
            return 0
        ways = (self.count[left] > 0).astype(np.int64)
        words = np.arange(1 << self.k)
        for s in range(left + 1, right - self.k + 2):
            more = np.zeros_like(ways)
            for bit in (0, 1):
                more += np.where(self.weight[s - 1][bit << self.k | words] > 0, ways[(bit << self.k | words) >> 1], 0)
            ways = np.minimum(more, 2 * MOST_PATHS)
        return int(ways[: 1 << (self.k - 1)].sum())

    def solve_bubbles(self) -> None:
        found = []
        # What each rank's edges weigh when the last area over it was closed; solving takes weights back from here.
        kept = self.weight.copy()
        for left, right, own in list(self.bubbles()):
            self._close(left, right)
            ranks = slice(left, max(right - self.k + 1, left))
            kept[ranks] = self.weight[ranks]
            ways = self._paths(left, right)
            self.areas.append((left, right, ways))
            found.append((left, right, own, 0 < ways < MOST_PATHS))
        self.closed = self.weight.copy()
        for left, right, own, simple in found:
            if simple:
                self._enumerate(left, right, own, kept)
        for left, right, own, simple in found:
            if not simple:
                self._greedy(left, right, kept)
                self.hint[left : right + 1] = TANGLE_HINT

    def _restore(self, kept: np.ndarray, edges: list[tuple[int, int]]) -> None:
        for s, e in edges:
            self.weight[s, e] = kept[s, e]
            self.weight[s, self.full - e] = kept[s, self.full - e]

    def _enumerate(self, left: int, right: int, own: list[int], kept: np.ndarray) -> None:
        """Keep the path of least error correction; of equal ones the first in the order of its bits."""
        paths = [(w, [w >> (self.k - 1 - j) & 1 for j in range(self.k)]) for w in range(1 << (self.k - 1)) if self.count[left, w] > 0]
        for s in range(left, right - self.k + 1):
            paths = [((w << 1 | bit) & self.mask, [*path, bit]) for w, path in paths for bit in (0, 1) if self.get(s, w, bit, True) > 0]
        if not paths:
            return
        table = np.array([p for _, p in paths])
        cost = np.zeros(len(paths), np.int64)
        for r in own:
            at, alleles = self.reads[r]
            called = alleles >= 0
            wrong = (table[:, at - left : at - left + len(alleles)][:, called] != alleles[called]).sum(1)
            cost += np.minimum(wrong, called.sum() - wrong)
        best = table[int(cost.argmin())].tolist()
        self.weight[left : right - self.k + 1] = 0
        self._restore(kept, [(s, int("".join(map(str, best[s - left : s - left + self.k + 1])), 2)) for s in range(left, right - self.k + 1)])

    def _greedy(self, left: int, right: int, kept: np.ndarray) -> None:
        """Keep the heaviest chains from right to left, k ranks apart."""
        n = right - left
        heavy = np.zeros((max(n, 1), 1 << self.k), np.int64)
        back = np.full((max(n, 1), 1 << self.k), -1, np.int64)
        words = np.arange(1 << self.k)
        for s in range(left + 1, right - self.k + 2):
            for bit in (0, 1):
                old, add = (bit << self.k | words) >> 1, self.weight[s - 1][bit << self.k | words]
                total = np.where(add > 0, heavy[s - 1 - left][old] + add, 0)
                better = total > heavy[s - left]
                heavy[s - left][better], back[s - left][better] = total[better], old[better]
        self.weight[left : max(right - self.k + 1, left)] = 0
        at = n - 1
        while at > 0:
            w = int(heavy[at].argmax())
            while back[at, w] >= 0:
                before = int(back[at, w])
                self._restore(kept, [(left + at - 1, before << 1 | (w & 1))])
                at, w = at - 1, before
            at -= self.k

    # Blocks.

    def blocks(self) -> list[tuple[int, list[int]]]:
        """(first variant, phases) of every path, by its first variant and word."""
        out = []
        for s in range(self.ranks):
            for w in range(1 << (self.k - 1)):
                if self.degree(s, w, False) == 0 and self.degree(s, w, True) == 1:
                    phases, rank, word = [w >> (self.k - 1 - j) & 1 for j in range(self.k)], s, w
                    while self.degree(rank, word, True):
                        bit = int(self.get(rank, word, 0, True) == 0)
                        phases.append(bit)
                        rank, word = self.step(rank, word, bit, True)
                    out.append((s, phases))
        return out


def tiles(blocks: list[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
    """The blocks, by their first variants, without those that a block before them reaches past."""
    wide: list[tuple[int, list[int]]] = []
    for first, phases in sorted(blocks, key=lambda b: (b[0], -len(b[1]))):
        if not wide or first + len(phases) > wide[-1][0] + len(wide[-1][1]):
            wide.append((first, phases))
    return wide


def de_overlap(blocks: list[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
    """Drop blocks that a block before them reaches past; append the free tails of those that overlap a block to it.

    Each variant is appended once, from the first block that has it.
    """
    wide = tiles(blocks)
    out, k = [], 0
    while k < len(wide):
        first, phases = wide[k]
        end, joined = first + len(phases), list(phases)
        k += 1
        while k < len(wide) and wide[k][0] < end:
            joined += wide[k][1][first + len(joined) - wide[k][0] :]
            k += 1
        out.append((first, joined))
    return out


def overlaps(blocks: list[tuple[int, list[int]]]) -> tuple[int, int]:
    """Variants of a block that a later one which is appended to it has too, and variants of all blocks after that."""
    wide = tiles(blocks)
    shared = 0
    for first, phases in de_overlap(blocks):
        end = next(a + len(p) for a, p in wide if a == first)
        shared += end - min((a for a, _ in wide if first < a < end), default=end)
    return shared, sum(len(p) for _, p in de_overlap(blocks))


class Correction:
    """Local correction of one block by the reads that lie wholly inside it.

    The reads' variants, gaps too, are laid out as cells, read after read, so
    that errors under any pattern come from running sums over the cells.
    """

    def __init__(self, first: int, phases: list[int], doubtful: np.ndarray, rows: list[tuple[int, np.ndarray]]):
        """rows: (first variant, alleles) of the reads; doubtful: a mark for each variant of the block."""
        self.phase, self.doubtful = np.array(phases), doubtful
        self.size = np.array([len(a) for _, a in rows], np.int64)
        self.left = np.array([s - first for s, _ in rows], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.read = np.repeat(np.arange(len(rows)), self.size)
        self.at = np.arange(self.size.sum()) - self.begin[self.read] + self.left[self.read]
        self.allele = np.concatenate([a for _, a in rows]) if rows else np.zeros(0, np.int64)
        self.called = (self.allele >= 0).astype(np.int64)
        self.calls = np.concatenate([[0], np.cumsum(self.called)])
        self.total = self.calls[self.begin + self.size] - self.calls[self.begin]
        # Every window with every read that touches it.
        windows = self.size + WINDOW - 1
        self.of = np.repeat(np.arange(len(rows)), windows)
        self.window = np.arange(windows.sum()) - (np.cumsum(windows) - windows)[self.of] + self.left[self.of] - WINDOW + 1
        whole = (self.window >= 0) & (self.window + WINDOW <= len(phases))
        self.of, self.window = self.of[whole], self.window[whole]

    def _wrong(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which cells disagree with the phases, their running sum, and each read's number of them."""
        wrong = self.called * (self.phase[self.at] != self.allele)
        sums = np.concatenate([[0], np.cumsum(wrong)])
        return wrong, sums, sums[self.begin + self.size] - sums[self.begin]

    def _per(self, where: np.ndarray, errors: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.bincount(where, np.minimum(errors, total - errors), len(self.phase))

    def _pattern_gains(self, pattern: int) -> np.ndarray:
        """Where reversing by the pattern from a variant on makes fewer errors."""
        wrong, sums, own = self._wrong()
        r, i = self.of, self.window
        begin, size, off = self.begin[r], self.size[r], i - self.left[r]
        errors = sums[begin + np.clip(off, 0, size)] - sums[begin]
        turned = 0
        for j in range(WINDOW):
            turned ^= pattern >> j & 1
            here = off + j
            cell = begin + np.clip(here, 0, size - 1)
            within = (here >= 0) & (here < size)
            errors = errors + np.where(within, np.where(turned, self.called[cell] - wrong[cell], wrong[cell]), 0)
        behind = begin + np.clip(off + WINDOW, 0, size)
        rest = sums[begin + size] - sums[behind]
        errors = errors + ((self.calls[begin + size] - self.calls[behind] - rest) if turned else rest)
        return self._per(i, errors, self.total[r]) < self._per(i, own[r], self.total[r])

    def _flip_gains(self) -> np.ndarray:
        wrong, _, own = self._wrong()
        r = self.read
        return self._per(self.at, own[r] + self.called - 2 * wrong, self.total[r]) < self._per(self.at, own[r], self.total[r])

    def _switch_gains(self) -> np.ndarray:
        """Where reversing all behind a variant makes fewer errors."""
        _, sums, own = self._wrong()
        r = self.read
        before = sums[1:] - sums[self.begin[r]]
        behind = self.total[r] - (self.calls[1:] - self.calls[self.begin[r]])
        return self._per(self.at, before + behind - (own[r] - before), self.total[r]) < self._per(self.at, own[r], self.total[r])

    def _apply(self, marks: np.ndarray) -> None:
        self.phase = self.phase ^ (np.cumsum(marks) % 2)

    def run(self) -> list[int]:
        n = len(self.phase)
        if not len(self.size):
            return self.phase.tolist()
        for pattern in PATTERNS:
            marks, free = np.zeros(n, np.int64), 0
            for i in np.flatnonzero(self._pattern_gains(pattern) & self.doubtful).tolist():
                if i >= free:
                    marks[i : i + WINDOW] |= [pattern >> j & 1 for j in range(WINDOW)]
                    free = i + WINDOW
            self._apply(marks)
        longest, i, gains = int(self.size.max()), 0, self._flip_gains()
        while i < n:
            if not gains[i:].any():
                break
            i += int(gains[i:].argmax())
            self.phase[i] ^= 1
            i += SKIP + 1
            if longest > SKIP:  # a read may have seen the change and reach behind the skipped variants
                gains = self._flip_gains()
        marks, free = np.zeros(n, np.int64), 1
        for pivot in np.flatnonzero(self._switch_gains()[: n - 1]).tolist():
            if pivot + 1 >= free:
                marks[pivot + 1] = 1
                free = pivot + SKIP + 2
        self._apply(marks)
        return self.phase.tolist()

    def part(self, open_left: bool, open_right: bool, longest: int) -> tuple[int, int]:
        """Correct a stretch of a block that goes on where a side is open; no read has more than `longest` variants, SKIP at most.

        Gives the first and the last variant that surely turn against the one
        before them as in the whole block. Errors are the same for a read and its complement, so that
        a change matters to the reads over it only. Changes that keep a distance from one another hang on the first of them: all
        first ones that may be are followed until they meet.
        """
        n = len(self.phase)
        sure, until = int(open_left), n - 1
        none = np.zeros(n, bool)

        def chosen(gains: np.ndarray, apart: int) -> tuple[np.ndarray, int, int]:
            low = sure + longest if open_left else 0
            high = until - longest - WINDOW if open_right else n - 1
            at = np.flatnonzero(gains)
            at = at[(at >= low) & (at <= high)]
            after = np.searchsorted(at, at + apart)
            ways = set(np.searchsorted(at, low + np.arange(apart)).tolist()) if open_left else {0}
            met = low
            if len(ways) > 1:
                while len(ways) > 1:
                    first = min(ways)
                    ways = ways - {first} | {int(after[first])}
                met = int(at[min(ways)]) if min(ways) < len(at) else high + 1
            j, picked = min(ways), []
            while j < len(at):
                picked.append(int(at[j]))
                j = int(after[j])
            return np.array(picked, np.int64), met, high

        for pattern in PATTERNS:
            picked, met, high = chosen(self._pattern_gains(pattern) & self.doubtful if len(self.size) else none, WINDOW)
            marks = np.zeros(n, np.int64)
            for j in range(WINDOW):
                marks[picked + j] = pattern >> j & 1
            self._apply(marks)
            sure, until = met + WINDOW - 1 if open_left else 0, high
        picked, met, high = chosen(self._flip_gains() if len(self.size) else none, SKIP + 1)
        self.phase[picked] ^= 1
        sure, until = met + 1 if open_left else 0, high
        gains = self._switch_gains() if len(self.size) else none
        gains[n - 1] = False
        picked, met, high = chosen(gains, SKIP + 1)
        marks = np.zeros(n, np.int64)
        marks[picked + 1] = 1
        self._apply(marks)
        return met + 1 if open_left else 0, high


def _island(rows: pd.DataFrame, k: int, n_snp: int, first: int, last: int | None = None) -> Island:
    kinds = {kind: part for kind, part in rows.groupby("kind")}
    calls = kinds["call"].sort_values(["a", "b"], kind="stable") if "call" in kinds else rows[:0]
    made = Island(k, first, int(calls.b.max()) if last is None else last, n_snp)
    snps, alleles = calls.b.to_numpy(), calls.c.to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(calls.a.to_numpy())) + 1).tolist(), len(calls)] if len(calls) else []
    for a, b in zip(edges, edges[1:]):
        made.add_read(snps[a:b], alleles[a:b])
    for kind, table in (("node", made.count), ("edge", made.weight)):
        if kind in kinds:
            part = kinds[kind]
            table[part.a.to_numpy() - first, part.b.to_numpy()] = part.c.to_numpy()
    if "hint" in kinds:
        made.hint[kinds["hint"].a.to_numpy() - first] = kinds["hint"].c.to_numpy()
    if "pair" in kinds:
        made.pairs = (kinds["pair"].a.to_numpy() - first).tolist()
    return made


def _long(name: str):
    return F.col(name).cast("long")


def _rows(table: DataFrame, kind: str, a: str, b: str | None = None, c: str | None = None) -> DataFrame:
    """Rows of a task, told apart by kind."""
    number = lambda name: _long(name) if name else F.lit(0).cast("long")
    return table.select("chrom", "task", F.lit(kind).alias("kind"), number(a).alias("a"), number(b).alias("b"), number(c).alias("c"))


def _tasks(runs: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """(chrom, at, task): the variants or ranks of runs, and so many on either side, with the task that each run is dealt to."""
    task = F.floor(F.col("island") / TASK)
    return runs.select("chrom", task.alias("task"), F.explode(F.sequence(F.col("island") - before, F.col("last") + after)).alias("at")).distinct()


def _tips(weights: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(chrom, kind, s, e): edges that go as tips ("edge"), and ranks of doubtful ones ("hint")."""
    u = weights.groupBy("chrom", "s", F.shiftright("e", 1).alias("w")).count()
    v = weights.groupBy("chrom", (F.col("s") + 1).alias("s"), F.col("e").bitwiseAND((1 << k) - 1).alias("w")).count()
    forks = u.union(v).filter("count > 1").select("chrom", "s").distinct()
    runs = _reads.runs(forks.select("chrom", (F.col("s") - APART).alias("first"), (F.col("s") + APART).alias("last")))
    near = _tasks(runs, BEHIND - APART, AHEAD - APART).withColumnRenamed("at", "s")
    rows = _rows(weights.join(shuffled(near), ["chrom", "s"]), "edge", "s", "e", "weight").join(F.broadcast(sizes), "chrom")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, last = int(pdf.a.min()), int(pdf.a.max())
        own = _island(pdf, k, int(pdf.n_snp.iloc[0]), first, last + k + 1)
        was = own.weight.copy()
        own.remove_tips()
        gone, hint = np.argwhere((was > 0) & (own.weight == 0)), np.flatnonzero(own.hint)
        made = [pd.DataFrame({"kind": "edge", "s": gone[:, 0] + first, "e": gone[:, 1]}), pd.DataFrame({"kind": "hint", "s": hint + first, "e": -1})]
        return pd.concat(made).assign(chrom=pdf.chrom.iloc[0])[["chrom", "kind", "s", "e"]]

    return rows.groupBy("chrom", "task").applyInPandas(run, "chrom string, kind string, s long, e long")


def _bubbles(reads: DataFrame, nodes: DataFrame, edges: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(stage, chrom, at, word, value): edges of the areas' runs once closed and once solved, areas, variants of tangles; and edges outside of any area."""
    pairs = stored(_areas.ambiguous_pairs(edges, k))
    spans = _reads.read_spans(reads)
    over = stored(spans.withColumn("snp_idx", F.explode(F.expr("CASE WHEN last > first THEN sequence(first + 1, last) ELSE array() END"))).join(shuffled(pairs), ["chrom", "snp_idx"], "left_semi"))
    bounds = over.groupBy("chrom", "snp_idx").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    bounds = pairs.join(shuffled(bounds), ["chrom", "snp_idx"], "left").select("chrom", F.coalesce("first", "snp_idx").alias("first"), F.coalesce("last", "snp_idx").alias("last"))
    near = stored(_tasks(_reads.runs(bounds)))
    at = lambda table, name: table.join(shuffled(near.withColumnRenamed("at", name)), ["chrom", name])
    held = at(over.select("chrom", "rid", "first").distinct(), "first").select("chrom", "rid", "task")
    rows = _rows(reads.join(shuffled(held), ["chrom", "rid"]), "call", "rid", "snp_idx", "allele")
    for table, kind, names in ((at(nodes, "s"), "node", ("s", "w", "cnt")), (at(edges, "s"), "edge", ("s", "e", "weight")), (at(pairs, "snp_idx"), "pair", ("snp_idx",))):
        rows = rows.unionByName(_rows(table, kind, *names))
    rows = rows.join(F.broadcast(sizes), "chrom")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # The places that rows begin at; calls name their read first.
        place = pdf.a.where(pdf.kind != "call", pdf.b)
        first, last = int(place.min()), int(place.max())
        own = _island(pdf, k, int(pdf.n_snp.iloc[0]), first, last + k + 1)
        own.solve_bubbles()
        out = []
        for stage, weight in (("closed", own.closed), ("bubbles", own.weight)):
            s, e = np.nonzero(weight > 0)
            out.append(pd.DataFrame({"stage": stage, "at": s + first, "word": e, "value": weight[s, e]}))
        out.append(pd.DataFrame([("areas", left + first, right + first, ways) for left, right, ways in own.areas], columns=["stage", "at", "word", "value"]))
        s = np.flatnonzero(own.hint)
        out.append(pd.DataFrame({"stage": "hints", "at": s + first, "word": -1, "value": own.hint[s]}))
        return pd.concat(out).assign(chrom=pdf.chrom.iloc[0])[["stage", "chrom", "at", "word", "value"]]

    solved = rows.groupBy("chrom", "task").applyInPandas(run, "stage string, chrom string, at long, word long, value long")
    apart = edges.join(shuffled(near.withColumnRenamed("at", "s")), ["chrom", "s"], "left_anti")
    return solved.unionByName(apart.select(F.explode(F.array(F.lit("closed"), F.lit("bubbles"))).alias("stage"), "chrom", _long("s").alias("at"), _long("e").alias("word"), _long("weight").alias("value")))


def _tiling(blocks: DataFrame) -> DataFrame:
    """(chrom, block, joined, first, end, over): the variants from `first` to before `end` of a block that it has in the block that begins at `joined`.

    over: variants of a block that a later one which is appended to it has too, told with the block's own row.
    Blocks: (chrom, block, snp_idx, phase). Only the bounds of blocks are held, by runs of blocks that overlap.
    """
    bounds = stored(blocks.groupBy("chrom", "block").agg(F.min("snp_idx").alias("first"), F.max("snp_idx").alias("last")))
    rows = bounds.join(shuffled(_tasks(_reads.runs(bounds)).withColumnRenamed("at", "first")), ["chrom", "first"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, reach, leader, end, joined = [], None, None, 0, 0
        over: dict[int, int] = {}
        for block, first, last in pdf.assign(n=-pdf["last"]).sort_values(["first", "n", "block"])[["block", "first", "last"]].itertuples(index=False):
            if reach is not None and last < reach:
                continue
            reach = last + 1
            if leader is None or first >= end:
                leader, end, joined = first, last + 1, last + 1
                out.append((block, leader, first, last + 1))
                over[leader] = 0
            else:
                over[leader] = max(over[leader], end - first)
                out.append((block, leader, joined, last + 1))
                joined = last + 1
        made = pd.DataFrame(out, columns=["block", "joined", "first", "end"])
        made["over"] = made.joined.map(over).where(made["first"] == made.joined, 0)
        return made.assign(chrom=pdf.chrom.iloc[0])[["chrom", "block", "joined", "first", "end", "over"]]

    return rows.groupBy("chrom", "task").applyInPandas(run, "chrom string, block long, joined long, first long, end long, over long")


def _joined(blocks: DataFrame, tiling: DataFrame) -> DataFrame:
    """(chrom, block, snp_idx, phase) of the blocks after the overlaps go, as `de_overlap` makes them."""
    bucket = lambda c: F.floor(c / _reads.BUCKET)
    parts = tiling.select("chrom", "block", "joined", "first", "end", F.explode(F.sequence(bucket(F.col("first")), bucket(F.col("end") - 1))).alias("bucket"))
    both = blocks.withColumn("bucket", bucket(F.col("snp_idx"))).join(shuffled(parts), ["chrom", "block", "bucket"])
    return both.filter("snp_idx >= first AND snp_idx < end").select("chrom", F.col("joined").alias("block"), "snp_idx", "phase")


def solve_stages(reads: DataFrame, k: int, stages: tuple[str, ...], sizes: DataFrame | None = None) -> DataFrame:
    """Run the passes on informative reads, once, and give what several stages leave.

    (stage, chrom, island, block, at, word, value): of "tips", "closed" (areas
    closed, not yet solved) and "bubbles" the edges, `at` being the rank and
    value the weight; of "hints" the doubtful variants and their kind; of "areas" the undecided areas, from variant `at` to `word`, and the ways through each (512 at most
    for an end); of "blocks" and "joined" the blocks, before and after the
    overlaps go, `at` being the variant and value the phase; of
    "shares" rows whose sums are variants in overlaps of blocks, in areas
    that are not enumerated, and in blocks. sizes: (chrom, n_snp) where it isn't the last
    variant that a read reaches.
    """
    if not set(stages) <= set(STAGES) or not stages:
        raise ValueError(f"stages are of {STAGES}")
    if not 2 <= k <= 5:
        raise ValueError("k is from 2 to 5")
    sizes = sizes or _reads.variant_counts(reads)
    nodes, patched, pairs = _kmers.patched_graph(reads, k)
    weights = stored(_kmers.edge_trim(patched))
    tips = stored(_tips(weights, sizes, k))
    edges = stored(weights.join(shuffled(tips.filter("kind = 'edge'").select("chrom", "s", "e")), ["chrom", "s", "e"], "left_anti"))
    islands = _reads.coverage_islands(reads).withColumnRenamed("snp_idx", "at")
    none = F.lit(-1).cast("long")
    made = []

    def add(stage: str, table: DataFrame, at: str, word=none, value=none, block=none) -> None:
        made.append(table.select(F.lit(stage).alias("stage"), "chrom", block.alias("block"), _long(at).alias("at"), word.alias("word"), value.alias("value")))

    if "tips" in stages:
        add("tips", edges, "s", _long("e"), _long("weight"))
    later = set(stages) - {"tips"}
    if later:
        solved = stored(_bubbles(reads, _kmers.isolated_node_reset(nodes, edges, k), edges, sizes, k))
        if kept := later & {"closed", "bubbles", "areas"}:
            made.append(solved.filter(F.col("stage").isin(*kept)).select("stage", "chrom", none.alias("block"), "at", "word", "value"))
        if "hints" in stages:
            # Tangles come after tips, and both after what the counts say.
            every = _hints.hints(pairs, sizes).join(shuffled(islands.select("chrom", F.col("at").alias("snp_idx"))), ["chrom", "snp_idx"], "left_semi").select("chrom", "snp_idx", _long("hint").alias("hint"))
            every = every.unionByName(tips.filter("kind = 'hint'").select("chrom", F.col("s").alias("snp_idx"), F.lit(TIP_HINT).cast("long").alias("hint")))
            every = every.unionByName(solved.filter("stage = 'hints'").select("chrom", F.col("at").alias("snp_idx"), F.col("value").alias("hint")))
            add("hints", every.groupBy("chrom", "snp_idx").agg(F.max("hint").alias("hint")), "snp_idx", value=F.col("hint"))
    if later & {"blocks", "joined", "shares"}:
        blocks = stored(_walks.haplotype_walks(solved.filter("stage = 'bubbles'").select("chrom", F.col("at").alias("s"), F.col("word").alias("e"), F.col("value").alias("weight")), k))
        if "blocks" in stages:
            add("blocks", blocks, "snp_idx", value=_long("phase"), block=F.col("block"))
        if later & {"joined", "shares"}:
            tiling = stored(_tiling(blocks))
        if "joined" in stages:
            add("joined", _joined(blocks, tiling), "snp_idx", value=_long("phase"), block=F.col("block"))
    columns = ["stage", "chrom", "island", "block", "at", "word", "value"]
    out = [reduce(DataFrame.unionByName, made).join(shuffled(islands), ["chrom", "at"]).select(columns)] if made else []
    if "shares" in stages:
        zero = F.lit(0).cast("long")
        tangled = solved.filter((F.col("stage") == "areas") & ((F.col("value") <= 0) | (F.col("value") >= MOST_PATHS)))
        each = tiling.select("chrom", F.col("over").alias("at"), zero.alias("word"), (F.col("end") - F.col("first")).alias("value"))
        each = each.unionByName(tangled.select("chrom", zero.alias("at"), (F.col("word") - F.col("at") + 1).alias("word"), zero.alias("value")))
        each = each.unionByName(_reads.variant_counts(reads).select("chrom", zero.alias("at"), zero.alias("word"), zero.alias("value")))
        sums = each.groupBy("chrom").agg(*[F.sum(c).alias(c) for c in ("at", "word", "value")])
        out.append(sums.select(F.lit("shares").alias("stage"), "chrom", none.alias("island"), none.alias("block"), "at", "word", "value"))
    return reduce(DataFrame.unionByName, out)


def edges_of(solved: DataFrame, stage: str) -> DataFrame:
    """(chrom, island, s, e, weight) of a stage of `solve_stages`."""
    return solved.filter(F.col("stage") == stage).select("chrom", "island", F.col("at").alias("s"), F.col("word").alias("e"), F.col("value").alias("weight"))


def blocks_of(solved: DataFrame, stage: str) -> DataFrame:
    """(chrom, island, block, snp_idx, phase) of a stage of `solve_stages`."""
    return solved.filter(F.col("stage") == stage).select("chrom", "island", "block", F.col("at").alias("snp_idx"), F.col("value").cast("int").alias("phase"))


def areas_of(solved: DataFrame) -> DataFrame:
    """(chrom, l_bound, r_bound, ways, kind) of the areas of `solve_stages`: "simple" ones are enumerated, "incomplete" and "complex" ones are tangles."""
    kind = F.when(F.col("value") == 0, "incomplete").when(F.col("value") < MOST_PATHS, "simple").otherwise("complex")
    rows = solved.filter(F.col("stage") == "areas")
    return rows.select("chrom", F.col("at").alias("l_bound"), F.col("word").alias("r_bound"), F.least("value", F.lit(MOST_PATHS)).alias("ways"), kind.alias("kind"))


def shares_of(solved: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chrom, overlap_percent, tangle_percent): of the variants in blocks those where blocks overlapped, of all those in tangles."""
    sums = solved.filter(F.col("stage") == "shares").groupBy("chrom").agg(F.sum("at").alias("over"), F.sum("word").alias("tangled"), F.sum("value").alias("in_blocks"))
    return sums.join(sizes, "chrom").select("chrom", (100.0 * F.col("over") / F.nullif("in_blocks", F.lit(0))).alias("overlap_percent"), (100.0 * F.col("tangled") / F.col("n_snp")).alias("tangle_percent"))


def correct_blocks(reads: DataFrame, blocks: DataFrame, hints: DataFrame) -> DataFrame:
    """Blocks (chrom, island, block, snp_idx, phase) after local correction, in pieces of variants.

    hints: (chrom, snp_idx) of the doubtful variants. A read that lies inside two blocks counts in both. A piece
    reads more variants on either side than it corrects; those whose result might still hang on what they
    haven't read are done again with more, the others stay. With reads of more than SKIP variants each block is one piece.
    """
    key = ["chrom", "island", "block"]
    ends = stored(blocks.groupBy(*key).agg(F.min("snp_idx").alias("begin"), F.max("snp_idx").alias("end")))
    bucket = lambda c: F.floor(c / _reads.BUCKET)
    # A block may be as long as a chromosome: its variants meet its ends bucket by bucket.
    held = shuffled(ends.withColumn("bucket", F.explode(F.sequence(bucket(F.col("begin")), bucket(F.col("end"))))))
    bounded = lambda rows: rows.withColumn("bucket", bucket(F.col("snp_idx"))).join(held, [*key, "bucket"]).drop("bucket")
    here = bounded(blocks).select(*key, F.col("snp_idx").alias("first"), "begin", "end")
    inside = stored(_reads.read_spans(reads).join(shuffled(here), ["chrom", "first"]).filter("last <= end").select(*key, "rid", "first", "last", "begin", "end"))
    longest = inside.agg(F.max(F.col("last") - F.col("first") + 1)).first()[0] or 0
    doubtful = hints.select("chrom", "snp_idx", F.lit(True).alias("doubtful")).distinct()
    own = bounded(blocks.join(shuffled(doubtful), ["chrom", "snp_idx"], "left"))
    behind, size = (len(PATTERNS) + 2) * (longest + WINDOW), PIECE if longest <= SKIP else None
    before = behind + SLACK
    done, again = [], None
    while True:
        tried = stored(_corrected(reads, own, inside, size, before, behind, longest, again))
        done.append(tried.filter("sure"))
        again = tried.filter("NOT sure").select(*key, "piece").distinct()
        if again.isEmpty():
            break
        before, behind = 4 * before, 4 * behind
    made = reduce(DataFrame.unionByName, done)
    # A piece tells its phases as if all pieces before it had left the last variant's phase as it was.
    turns = made.groupBy(*key, "piece").agg(F.max("turned").alias("turned"))
    earlier = W.partitionBy(*key).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.select(*key, "piece", (F.coalesce(F.sum("turned").over(earlier), F.lit(0)) % 2).cast("int").alias("before"))
    return made.join(turns, [*key, "piece"]).select(*key, "snp_idx", F.col("phase").bitwiseXOR(F.col("before")).alias("phase"))


def _corrected(reads: DataFrame, own: DataFrame, inside: DataFrame, size: int | None, before: int, behind: int, longest: int, only: DataFrame | None = None) -> DataFrame:
    """(chrom, island, block, piece, snp_idx, phase, turned, sure) of pieces of `size` variants, with so many before and behind them; whole blocks without a size.

    only: the pieces (chrom, island, block, piece) that are asked for.
    """
    key = ["chrom", "island", "block"]
    wanted = lambda rows: rows if only is None else rows.join(only, [*key, "piece"], "left_semi")

    def pieces(first: str, last: str):
        """The pieces that read all from a variant to another one of a block."""
        if size is None:
            return F.array(F.floor(F.col("begin") * 0))
        low = F.greatest(F.floor((F.col(last) - behind) / size), F.floor(F.col("begin") / size))
        high = F.least(F.floor((F.col(first) + before) / size), F.floor(F.col("end") / size))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    null = F.lit(None).cast("long")
    calls = reads.join(shuffled(wanted(inside.select(*key, "rid", F.explode(pieces("first", "last")).alias("piece")))), ["chrom", "rid"])
    rows = own.select(*key, F.explode(pieces("snp_idx", "snp_idx")).alias("piece"), null.alias("rid"), _long("snp_idx").alias("snp_idx"), _long("phase").alias("value"), F.coalesce("doubtful", F.lit(False)).alias("doubtful"), _long("begin").alias("begin"), _long("end").alias("end"))
    rows = wanted(rows).unionByName(calls.select(*key, "piece", _long("rid").alias("rid"), _long("snp_idx").alias("snp_idx"), _long("allele").alias("value"), F.lit(False).alias("doubtful"), null.alias("begin"), null.alias("end")))

    def block(mine: pd.DataFrame, calls: pd.DataFrame, piece: int) -> pd.DataFrame:
        mine, calls = mine.sort_values("snp_idx"), calls.sort_values(["rid", "snp_idx"])
        snps, alleles, variants = calls.snp_idx.to_numpy(), calls.value.to_numpy(), mine.snp_idx.to_numpy()
        first, begin, end = int(variants[0]), int(mine.begin.iloc[0]), int(mine.end.iloc[0])
        edges = [0, *(np.flatnonzero(np.diff(calls.rid.to_numpy())) + 1).tolist(), len(calls)] if len(calls) else []
        found = []
        for a, b in zip(edges, edges[1:]):
            row = np.full(snps[b - 1] - snps[a] + 1, -1, np.int64)
            row[snps[a:b] - snps[a]] = alleles[a:b]
            found.append((int(snps[a]), row))
        was = mine.value.to_numpy()
        made = Correction(first, was.tolist(), mine.doubtful.to_numpy(bool), found)
        if size is None:
            return mine[key + ["snp_idx"]].assign(phase=made.run(), turned=0, sure=True)
        open_left, open_right = first > begin, int(variants[-1]) < end
        low, high = made.part(open_left, open_right, longest)
        held = np.flatnonzero(variants // size == piece)
        a, b = int(held[0]), int(held[-1])
        change = made.phase ^ was
        last = int(change[a - 1]) if a else 0
        sure = (not open_left or low <= a) and (not open_right or high >= b)
        return mine[key + ["snp_idx"]].iloc[held].assign(phase=made.phase[held] ^ last, turned=int(change[b]) ^ last, sure=sure)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        piece = int(pdf.piece.iloc[0])
        none, of = pdf[:0], {}
        calls = pdf.rid.notna()
        for name, g in pdf[calls].groupby("block"):
            of[name] = g
        made = [block(g, of.get(name, none), piece) for name, g in pdf[~calls].groupby("block")]
        return pd.concat(made).assign(piece=piece) if made else pd.DataFrame(columns=[*key, "snp_idx", "phase", "turned", "sure", "piece"])

    task = ["chrom", "island", "piece"] if size else [*key, "piece"]
    return rows.groupBy(*task).applyInPandas(run, "chrom string, island long, block long, snp_idx long, phase int, turned int, sure boolean, piece long")


def corrected_of(solved: DataFrame, reads: DataFrame) -> DataFrame:
    """(chrom, island, block, snp_idx, phase) after local correction, from the stages "joined" and "hints" of `solve_stages`, as a table."""
    hints = solved.filter(F.col("stage") == "hints").select("chrom", F.col("at").alias("snp_idx"))
    return correct_blocks(reads, blocks_of(solved, "joined"), hints)


def solve(reads: DataFrame, k: int, stage: str = "corrected", sizes: DataFrame | None = None) -> DataFrame:
    """Edges of "tips" and "bubbles", blocks of "blocks" and "corrected", the last after local correction."""
    if stage not in ("tips", "bubbles", "blocks", "corrected"):
        raise ValueError("the other stages are of solve_stages")
    if stage == "corrected":
        return corrected_of(stored(solve_stages(reads, k, ("joined", "hints"), sizes)), reads)
    solved = solve_stages(reads, k, (stage,), sizes)
    return (edges_of if stage in ("tips", "bubbles") else blocks_of)(solved, stage)
