"""The cut of greatest likelihood by contraction, and tangles that are solved with it.

A cut has two shores. From one or two first variants on, the variant whose side
matters most joins the shore where it gives the fragments more likelihood, until all
have joined; then the one shore is reversed. Cuts are grown from the heaviest edges, and after
those from edges and variants that a generator draws; the best one counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bubbles as _bubbles
from . import reads as _reads
from .cut import PATIENCE, QUALITY, ROUNDS, SEEDS
from .solver import Island
from .stored import shuffled

#: An edge of at least this weight is no seed when it is drawn.
SURE = 1.0
S, T, NONE = 1, -1, 0


class Draws:
    """The 48-bit linear congruential generator of POSIX, in its initial state: numbers from 0 to 1."""

    def __init__(self):
        self.state = 0x1234ABCD330E

    def __call__(self) -> float:
        self.state = (0x5DEECE66D * self.state + 0xB) % (1 << 48)
        return self.state / (1 << 48)


class MaxHeap:
    """Items by their keys, the greatest first, of equal ones the least item; a key may rise and fall."""

    def __init__(self, keys: dict[int, float]):
        self.key, self.items = dict(keys), list(keys)
        self.place = {item: i for i, item in enumerate(self.items)}
        for i in reversed(range(len(self.items) // 2)):
            self._down(i)

    def __len__(self) -> int:
        return len(self.items)

    def _up(self, i: int) -> int:
        items, key, place = self.items, self.key, self.place
        item = items[i]
        own = (key[item], -item)
        while i:
            above = items[(i - 1) // 2]
            if own < (key[above], -above):
                break
            items[i], place[above] = above, i
            i = (i - 1) // 2
        items[i], place[item] = item, i
        return i

    def _down(self, i: int) -> None:
        items, key, place = self.items, self.key, self.place
        item, size = items[i], len(items)
        own = (key[item], -item)
        while (child := 2 * i + 1) < size:
            below = items[child]
            best = (key[below], -below)
            if child + 1 < size:
                right = items[child + 1]
                if (key[right], -right) > best:
                    child, below, best = child + 1, right, (key[right], -right)
            if best < own:
                break
            items[i], place[below] = below, i
            i = child
        items[i], place[item] = item, i

    def pop(self) -> int:
        top = self.items[0]
        last = self.items.pop()
        del self.place[top], self.key[top]
        if self.items:
            self.items[0], self.place[last] = last, 0
            self._down(0)
        return top

    def update(self, item: int, key: float) -> None:
        self.key[item] = key
        self._down(self._up(self.place[item]))


class Calls:
    """The calls of an area's fragments: `of` which fragment, of which variant, and whether they agree (1) or not (-1) with its phase.

    All calls are of one quality, so that a fragment's likelihood hangs on how many more of its calls agree than don't.
    """

    def __init__(self, phase: np.ndarray, of: np.ndarray, variant: np.ndarray, allele: np.ndarray):
        order = np.lexsort((variant, of))
        self.n = len(phase)
        self.of, self.variant = of[order], variant[order]
        self.sign = np.where(allele[order] == phase[self.variant], 1, -1)
        self.size = np.bincount(self.of)
        self.start = np.cumsum(self.size) - self.size
        self.by_variant = np.argsort(self.variant, kind="stable")
        self.bounds = np.searchsorted(self.variant[self.by_variant], np.arange(self.n + 1))
        p = 10 ** (-QUALITY / 10)
        depth = np.arange(self.size.max(initial=0) + 2) * (np.log10(1 - p) - np.log10(p)) / 2
        self.level = depth + np.log10(1 + 10 ** (-2 * depth))
        self.odds = np.log10((p * p + (1 - p) * (1 - p)) / (2 * p * (1 - p)))
        # A variant has a few calls only: plain lists are faster than arrays of so few items.
        self.lists = [x.tolist() for x in (self.sign, self.of, self.variant, self.size, self.start, self.by_variant, self.bounds, self.level)]

    def edges(self) -> list[tuple[int, int, float]]:
        """(u, v, weight) of neighbours within fragments, both ways, by u and v."""
        at = np.flatnonzero(self.of[1:] == self.of[:-1])
        u, v = self.variant[at], self.variant[at + 1]
        keys, edge = np.unique(u * self.n + v, return_inverse=True)
        weight = np.bincount(edge, self.sign[at] * self.sign[at + 1] * self.odds / (self.size[self.of[at]] - 1), len(keys)).round(9)
        one = list(zip((keys // self.n).tolist(), (keys % self.n).tolist(), weight.tolist()))
        return sorted(one + [(b, a, w) for a, b, w in one])

    def grow(self, s: int, t: int | None, draws: Draws) -> tuple[float, np.ndarray] | None:
        """The gain in log10 likelihood of the cut from the given variants, and each variant's shore; None if one shore stays empty."""
        sign, of, variant, size, start, by_variant, bounds, level = self.lists
        shore, score, held = [NONE] * self.n, [0.0] * self.n, [0] * len(size)
        heap: MaxHeap | None = None

        def key(j: int) -> int:
            """In units of the ninth decimal."""
            return abs(round(score[j] * 1e9))

        def join(i: int, to: int) -> None:
            shore[i], touched = to, set()
            for c in by_variant[bounds[i] : bounds[i + 1]]:
                r = of[c]
                before = held[r]
                after = held[r] = before + to * sign[c]
                step = level[abs(after + 1)] - level[abs(after - 1)] - level[abs(before + 1)] + level[abs(before - 1)]
                for other in range(start[r], start[r] + size[r]):
                    j = variant[other]
                    score[j] += sign[other] * step
                    touched.add(j)
            if heap is not None:
                for j in touched:
                    if shore[j] == NONE and heap.key[j] != key(j):
                        heap.update(j, key(j))

        join(s, S)
        if t is not None:
            join(t, T)
        heap = MaxHeap({j: key(j) for j in range(self.n) if shore[j] == NONE})
        while len(heap):
            i = heap.pop()
            pull = round(score[i], 9)
            if pull > 0:
                to = S
            elif pull < 0 or t is None:
                to = T
            else:
                to = S if draws() < 0.5 else T
            if to == T and t is None:
                t = i
            join(i, to)
        if t is None:
            return None
        whole = np.bincount(self.of, self.sign, len(self.size)).astype(np.int64)
        return float((self.level[abs(np.array(held))] - self.level[abs(whole)]).sum()), np.array(shore)


def contraction_cut(phase: np.ndarray, of: np.ndarray, variant: np.ndarray, allele: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, phases) of the best cut: its one shore reversed, or the phases as they are if no cut gains.

    The seeds are the heaviest edges, SEEDS at most and no more than half of them, then by turns of the
    generator an edge (a sure one is passed over) or a single variant. A tenth as many as there are variants
    are drawn, 1 to ROUNDS; the search ends when more than PATIENCE cuts in all were no better than the best before them.
    """
    if not len(of):
        return 0.0, phase.copy()
    calls, draws = Calls(phase, of, variant, allele), Draws()
    edges = calls.edges()
    seeds = sorted(edges, key=lambda e: (-round(e[2], 5), e[0], e[1]))[: min(len(edges) // 2, SEEDS)]
    best, idle = (-np.inf, None), 0
    for turn in range(len(seeds) + min(max(calls.n // 10, 1), ROUNDS)):
        if turn < len(seeds):
            s, t = seeds[turn][:2]
        elif draws() < 0.5 and edges:
            s, t, weight = edges[int(draws() * len(edges))]
            if weight >= SURE:
                continue
        else:
            s, t = int(draws() * calls.n), None
        made = calls.grow(s, t, draws)
        if made is None:
            continue
        if round(made[0], 9) > round(best[0], 9):
            best = made
        else:
            idle += 1
            if idle > PATIENCE:
                break
    gain, shore = best
    if shore is None or round(gain, 9) <= 0:
        return 0.0, phase.copy()
    return gain, phase ^ (shore == T)


def max_likelihood_cut(frags: DataFrame, phases: DataFrame) -> DataFrame:
    """(chrom, block, snp_idx, phase) after the best cut of each block of `phases` (chrom, block, snp_idx, phase); fragments count in the block of their variants."""
    rows = phases.join(frags.withColumnRenamed("variant", "snp_idx"), ["chrom", "snp_idx"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        snps, at = np.unique(pdf.snp_idx.to_numpy(), return_inverse=True)
        phase = np.zeros(len(snps), np.int64)
        phase[at] = pdf.phase.to_numpy()
        called = pdf.frag.notna().to_numpy()
        _, of = np.unique(pdf.frag[called].to_numpy(), return_inverse=True)
        _, made = contraction_cut(phase, of, at[called], pdf.allele[called].to_numpy().astype(np.int64))
        return pd.DataFrame({"chrom": pdf.chrom.iloc[0], "block": pdf.block.iloc[0], "snp_idx": snps, "phase": made})

    return rows.groupBy("chrom", "block").applyInPandas(run, "chrom string, block long, snp_idx long, phase int")


def errors(path: np.ndarray, of: np.ndarray, variant: np.ndarray, allele: np.ndarray) -> int:
    """The error correction of fragments by a path and its complement."""
    if not len(of):
        return 0
    calls, wrong = np.bincount(of), np.bincount(of, path[variant] != allele).astype(np.int64)
    return int(np.minimum(wrong, calls - wrong).sum())


def seed_path(k: int, size: int, edges: list[tuple[int, int, int]]) -> np.ndarray:
    """The alleles along the heaviest chains of an area's edges (rank, word, weight), from left to right; where a chain breaks off, 1."""
    area = Island(k, 0, size - 1, size)
    for s, e, weight in edges:
        area.weight[s, e] = weight
    area._greedy(0, size - 1, area.weight.copy())
    w = next((w for w in range(1 << k) if area.degree(0, w, True) == 1), 0)
    path = [w >> (k - 1 - j) & 1 for j in range(k)][:size]
    for s in range(size - k):
        path.append(int(area.get(s, w, 0, True) == 0))
        w = (w << 1 | path[-1]) & area.mask
    return np.array(path)


def tangle_cut(reads: DataFrame, closed: DataFrame, pairs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Each tangle's path, and its weights rewritten.

    (chrom, bubble, l_bound, r_bound, n_reads, seed_mec, mec, path): a path is
    seeded from the heaviest chains and bettered by the cut of greatest likelihood over the reads of
    the area's ambiguous pairs; a cut that would raise the error correction is not taken. And (chrom, bubble, s, e, weight): of an area's edges
    only those on the path stay, with their weights.

    closed: the graph with its areas closed (chrom, s, e, weight); pairs: (chrom, snp_idx, bubble, l_bound, r_bound) of the ambiguous
    pairs of the tangles to be solved. An area is a group; its size is that of the reads over one run of ambiguous pairs.
    """
    areas = pairs.groupBy("chrom", "bubble").agg(F.first("l_bound").alias("l_bound"), F.first("r_bound").alias("r_bound"))
    own = _reads.adjacent_reads(reads).join(shuffled(pairs.select("chrom", "snp_idx", "bubble")), ["chrom", "snp_idx"]).select("chrom", "bubble", "rid").distinct()
    calls = reads.filter("allele >= 0").join(shuffled(own), ["chrom", "rid"]).join(shuffled(areas), ["chrom", "bubble"])
    long = lambda c: F.col(c).cast("long")
    ranks = areas.withColumn("s", F.explode(F.sequence("l_bound", F.greatest(F.col("r_bound") - k, F.col("l_bound")))))
    weights = closed.join(shuffled(ranks), ["chrom", "s"]).filter(F.col("s") <= F.col("r_bound") - k)
    rows = calls.select("chrom", "bubble", "l_bound", "r_bound", F.lit("call").alias("kind"), long("rid").alias("a"), long("snp_idx").alias("b"), long("allele").alias("c"))
    rows = rows.unionByName(weights.select("chrom", "bubble", "l_bound", "r_bound", F.lit("edge").alias("kind"), long("s").alias("a"), long("e").alias("b"), long("weight").alias("c")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chrom, bubble, left, right = pdf[["chrom", "bubble", "l_bound", "r_bound"]].iloc[0]
        size = int(right - left + 1)
        edge, call = pdf[pdf.kind == "edge"], pdf[pdf.kind == "call"]
        weight = {(int(s - left), int(e)): int(w) for s, e, w in zip(edge.a, edge.b, edge.c)}
        path = seed_path(k, size, [(s, e, w) for (s, e), w in weight.items()])
        _, of = np.unique(call.a.to_numpy(), return_inverse=True)
        variant, allele = (call.b - left).to_numpy(), call.c.to_numpy()
        before = errors(path, of, variant, allele)
        gain, turned = contraction_cut(path, of, variant, allele)
        after = errors(turned, of, variant, allele)
        if after <= before:
            path = turned
        text = "".join(map(str, path.tolist()))
        out = [(chrom, bubble, "path", left, right, len(np.unique(of)), before, min(before, after), text)]
        full = (2 << k) - 1
        for s in range(size - k):
            e = int(text[s : s + k + 1], 2)
            out += [(chrom, bubble, "edge", s + left, word, weight[s, word], 0, 0, "") for word in (e, full - e) if (s, word) in weight]
        return pd.DataFrame(out, columns=["chrom", "bubble", "kind", "a", "b", "c", "d", "e", "path"])

    made = rows.groupBy("chrom", "bubble").applyInPandas(run, "chrom string, bubble long, kind string, a long, b long, c long, d long, e long, path string")
    paths = made.filter("kind = 'path'").select("chrom", "bubble", F.col("a").alias("l_bound"), F.col("b").alias("r_bound"), F.col("c").alias("n_reads"), F.col("d").alias("seed_mec"), F.col("e").alias("mec"), "path")
    return paths, made.filter("kind = 'edge'").select("chrom", "bubble", F.col("a").alias("s"), F.col("b").alias("e"), F.col("c").alias("weight"))


def tangle_pairs(reads: DataFrame, tips: DataFrame, areas: DataFrame, k: int) -> DataFrame:
    """(chrom, snp_idx, bubble, l_bound, r_bound): the ambiguous pairs of the areas (chrom, l_bound, r_bound, kind) that are not simple."""
    marked = _bubbles.bubble_pairs(_bubbles.bubble_bounds(_bubbles.ambiguous_pairs(tips, k), reads))
    whole = marked.groupBy("chrom", "bubble").agg(F.min("l_bound").alias("l_bound"), F.max("r_bound").alias("r_bound"))
    tangles = whole.join(shuffled(areas.filter("kind <> 'simple'").select("chrom", "l_bound", "r_bound").distinct()), ["chrom", "l_bound", "r_bound"], "left_semi")
    return marked.select("chrom", "snp_idx", "bubble").join(shuffled(tangles), ["chrom", "bubble"])
