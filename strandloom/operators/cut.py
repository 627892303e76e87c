"""Alternates for undecided areas: likelihood cuts of a fragment graph, exact error correction, and scores of given paths.

The default plan doesn't use these; they work on fragments (frag, variant,
allele), which are reads without their gaps.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions.numbers import cut_edge_weight, logsumexp10, phred_to_prob

#: The quality that every call is given, edges that seed a cut, rounds at most, rounds without gain.
QUALITY, SEEDS, ROUNDS, PATIENCE = 17, 5, 100, 5
#: Reads over a column that exact error correction allows.
MOST_COVERAGE = 15


def fragments(reads: DataFrame) -> DataFrame:
    """(chrom, frag, variant, allele) of reads with at least two alleles."""
    called = reads.filter("allele >= 0").select("chrom", F.col("rid").alias("frag"), F.col("snp_idx").alias("variant"), "allele")
    return called.withColumn("_n", F.count("*").over(W.partitionBy("chrom", "frag"))).filter("_n > 1").drop("_n")


def read_variant_graph(frags: DataFrame) -> DataFrame:
    """(chrom, frag, u, v, equal, share): each two consecutive variants of a fragment, both ways; share is 1 / (size - 1)."""
    along, whole = W.partitionBy("chrom", "frag").orderBy("variant"), W.partitionBy("chrom", "frag")
    steps = frags.select("chrom", "frag", F.col("variant").alias("u"), F.lead("variant").over(along).alias("v"), (F.col("allele") == F.lead("allele").over(along)).cast("int").alias("equal"), (1 / (F.count("*").over(whole) - 1)).alias("share")).filter("v IS NOT NULL")
    return steps.union(steps.select("chrom", "frag", F.col("v").alias("u"), F.col("u").alias("v"), "equal", "share"))


def cut_edge_agg(graph: DataFrame, phases: DataFrame) -> DataFrame:
    """(chrom, u, v, weight): how far fragments support two variants' phases (chrom, snp_idx, phase), as summed log odds."""
    p = phred_to_prob(F.lit(float(QUALITY)))
    u, v = (phases.select("chrom", F.col("snp_idx").alias(n), F.col("phase").alias(f"phase_{n}")) for n in "uv")
    both = graph.join(u, ["chrom", "u"]).join(v, ["chrom", "v"])
    odds = cut_edge_weight(p, p, F.col("equal"), (F.col("phase_u") == F.col("phase_v")).cast("int"))
    return both.groupBy("chrom", "u", "v").agg(F.sum(odds * F.col("share")).alias("weight"))


def topk_cut_edges(edges: DataFrame, k: int = SEEDS) -> DataFrame:
    """The k heaviest edges of each chromosome, but half of them at most; weights that differ by less than 0.00001 count as equal, and then those of the least variants come first."""
    rank = F.row_number().over(W.partitionBy("chrom").orderBy(F.desc(F.round("weight", 5)), "u", "v"))
    first = edges.withColumn("rank", rank).filter(F.col("rank") <= k)
    sizes = edges.groupBy("chrom").agg(F.expr("count(*) div 2").alias("_half"))
    return first.join(sizes, "chrom").filter(F.col("rank") <= F.col("_half")).drop("_half")


def sorted_adjacency(edges: DataFrame) -> DataFrame:
    """(chrom, u, edges): for each variant its edges (v, weight) by their other end."""
    return edges.groupBy("chrom", "u").agg(F.array_sort(F.collect_list(F.struct("v", "weight"))).alias("edges"))


def fragment_score(frags: DataFrame, phases: DataFrame) -> DataFrame:
    """(chrom, frag, score): log10 of the likelihood of each fragment, from either haplotype."""
    p = phred_to_prob(F.lit(float(QUALITY)))
    hit = F.col("allele") == F.col("phase")
    own = frags.join(phases.withColumnRenamed("snp_idx", "variant"), ["chrom", "variant"])
    sums = own.groupBy("chrom", "frag").agg(F.sum(F.log10(F.when(hit, 1 - p).otherwise(p))).alias("one"), F.sum(F.log10(F.when(hit, p).otherwise(1 - p))).alias("other"))
    return sums.select("chrom", "frag", logsumexp10(F.col("one"), F.col("other")).alias("score"))


def _grow(sign: np.ndarray, of: np.ndarray, variant: np.ndarray, size: np.ndarray, by_variant: np.ndarray, bounds: np.ndarray, seed: tuple[int, int]) -> tuple[float, list[int]]:
    """The gain in log10 likelihood of the best cut that grows from an edge, and the variants it reverses.

    `sign` is 1 for a call that agrees with its variant's phase, else -1. As all
    calls are of one quality, a fragment's likelihood hangs on one integer: how many
    more of its calls agree than don't. So does what a further variant gains by its
    side. Adding a variant touches its own fragments only; stale entries of the heap
    are passed over.
    """
    p = 10 ** (-QUALITY / 10)
    depth = np.arange(size.max() + 2) * (np.log10(1 - p) - np.log10(p)) / 2
    # A variant has a few calls only: plain lists are faster than arrays of so few items.
    level = (depth + np.log10(1 + 10 ** (-2 * depth))).tolist()
    whole = np.bincount(of, sign, len(size)).astype(np.int64).tolist()
    start, n = (np.cumsum(size) - size).tolist(), len(bounds) - 1
    sign, of, variant, size, by_variant, bounds = (x.tolist() for x in (sign, of, variant, size, by_variant, bounds))
    side, score, held = [0] * n, [0.0] * n, [0] * len(size)
    heap: list[tuple[int, int]] = []
    gain, reversed_, best = 0.0, [], (0.0, 0)

    def certain(i: int) -> int:
        """In units of the ninth decimal."""
        return -round(abs(score[i]) * 1e9)

    def add(i: int, to: int) -> None:
        nonlocal gain, best
        side[i] = to
        touched, gains = set(), []
        for c in by_variant[bounds[i] : bounds[i + 1]]:
            r, agrees = of[c], sign[c]
            before = held[r]
            after = held[r] = before + to * agrees
            if to < 0:
                old = whole[r]
                new = whole[r] = old - 2 * agrees
                gains.append(level[abs(new)] - level[abs(old)])
            step = level[abs(after + 1)] - level[abs(after - 1)] - level[abs(before + 1)] + level[abs(before - 1)]
            for other in range(start[r], start[r] + size[r]):
                j = variant[other]
                score[j] += sign[other] * step
                touched.add(j)
        if to < 0:
            gain += float(np.sum(gains))
            reversed_.append(i)
            if round(gain, 9) > round(best[0], 9):
                best = gain, len(reversed_)
        for j in touched:
            if side[j] == 0:
                heapq.heappush(heap, (certain(j), j))

    add(seed[0], 1)
    add(seed[1], -1)
    while heap:
        key, i = heapq.heappop(heap)
        if side[i] or key != certain(i):
            continue
        if key == 0:
            break
        add(i, 1 if score[i] > 0 else -1)
    return best[0], reversed_[:best[1]]


def improve_by_cuts(phase: np.ndarray, of: np.ndarray, variant: np.ndarray, allele: np.ndarray) -> np.ndarray:
    """Phases of greater likelihood: again and again the side of a cut is reversed that fragments support least.

    Each cut grows from one edge's ends, the weakest edges first, adding the
    variant whose side gains most likelihood; the sides of all stages are tried
    and the best kept. A fragment has at most one call of a variant. Memory is
    linear in the calls; a cut takes time in proportion to each call times the
    length of its fragment.
    """
    if not len(of):
        return phase.copy()
    n = len(phase)
    order = np.lexsort((variant, of))
    of, variant, allele = of[order], variant[order], allele[order]
    size = np.bincount(of)
    by_variant = np.argsort(variant, kind="stable")
    bounds = np.searchsorted(variant[by_variant], np.arange(n + 1))
    joined = np.flatnonzero(of[1:] == of[:-1])
    edges, edge = np.unique(variant[joined] * n + variant[joined + 1], return_inverse=True)
    phase, idle = phase.copy(), 0
    for turn in range(min(ROUNDS, n // 10 + SEEDS) if len(edges) else 0):
        sign = np.where(allele == phase[variant], 1, -1)
        weight = np.bincount(edge, sign[joined] * sign[joined + 1] / (size[of[joined]] - 1))
        seed = edges[np.lexsort((edges, weight.round(9)))[turn % len(edges)]]
        gain, turned = _grow(sign, of, variant, size, by_variant, bounds, (int(seed // n), int(seed % n)))
        if gain > 1e-9:
            phase[turned] ^= 1
            idle = 0
        else:
            idle += 1
            if idle > PATIENCE:
                break
    return phase


def blocks_by_cuts(frags: DataFrame, phases: DataFrame) -> DataFrame:
    """(chrom, block, snp_idx, phase) after `improve_by_cuts` in each block of `phases` (chrom, block, snp_idx, phase); fragments count in the block of their variants."""
    rows = phases.join(frags.withColumnRenamed("variant", "snp_idx"), ["chrom", "snp_idx"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        snps, at = np.unique(pdf.snp_idx.to_numpy(), return_inverse=True)
        phase = np.zeros(len(snps), np.int64)
        phase[at] = pdf.phase.to_numpy()
        own = pdf[pdf.frag.notna()]
        _, of = np.unique(own.frag.to_numpy(), return_inverse=True)
        made = improve_by_cuts(phase, of, at[pdf.frag.notna().to_numpy()], own.allele.to_numpy().astype(np.int64)) if len(own) else phase
        return pd.DataFrame({"chrom": pdf.chrom.iloc[0], "block": pdf.block.iloc[0], "snp_idx": snps, "phase": made})

    return rows.groupBy("chrom", "block").applyInPandas(run, "chrom string, block long, snp_idx long, phase int")


def exact_mec(rows: list[tuple[int, list[int]]], first: int, last: int) -> int:
    """The least error correction of reads (first variant, alleles) by any two haplotypes that differ everywhere.

    Columns are taken one by one. The flat table has a bit for each read over the
    column but the first one, which is the haplotype that the read is given; that of the first is 0, as
    errors are the same with all bits reversed. Reads that have
    ended are minimised out. At most MOST_COVERAGE reads may be over a column.
    """
    best, held, at = np.zeros(1, np.int64), [], 0
    rows = sorted(rows, key=lambda r: r[0])
    words = np.arange(1 << (MOST_COVERAGE - 1), dtype=np.uint16)
    for s in range(first, last + 1):
        for axis in reversed([i for i, (a, row) in enumerate(held) if a + len(row) <= s]):
            if axis:
                best = best.reshape(1 << (axis - 1), 2, -1).min(axis=1).ravel()
            elif len(held) > 1:
                best = np.minimum(best, best[::-1])[: len(best) // 2]
            del held[axis]
        while at < len(rows) and rows[at][0] <= s:
            if rows[at][0] + len(rows[at][1]) > s:
                best = np.repeat(best, 2) if held and len(held) < MOST_COVERAGE else best
                held.append(rows[at])
            at += 1
        if len(held) > MOST_COVERAGE:
            raise ValueError(f"{len(held)} reads over variant {s}; at most {MOST_COVERAGE} are allowed")
        alleles = [row[s - a] for a, row in held]
        called = sum(1 << i for i, allele in enumerate(reversed(alleles)) if allele >= 0)
        ones = sum(1 << i for i, allele in enumerate(reversed(alleles)) if allele > 0)
        wrong = np.bitwise_count((words[: len(best)] & called) ^ ones)
        best = best + np.minimum(wrong, called.bit_count() - wrong)
    return int(best.min())


def covered(rows: list[tuple[int, list[int]]], most: int) -> list[tuple[int, list[int]]]:
    """Reads from left to right, long ones first, as long as no column gets more than `most`."""
    depth: dict[int, int] = {}
    kept = []
    for a, row in sorted(rows, key=lambda r: (r[0], -len(r[1]), r[1])):
        columns = range(a, a + len(row))
        if all(depth.get(s, 0) < most for s in columns):
            kept.append((a, row))
            for s in columns:
                depth[s] = depth.get(s, 0) + 1
    return kept


def tangle_dp(reads: DataFrame, areas: DataFrame, most: int = MOST_COVERAGE) -> DataFrame:
    """(chrom, bubble, n_reads, mec): the exact error correction of each area (chrom, bubble, l_bound, r_bound) by reads inside it, thinned to at most `most` over a variant."""
    spans = reads.groupBy("chrom", "rid").agg(F.min("snp_idx").alias("first"), F.max("snp_idx").alias("last"))
    columns = areas.select("chrom", "bubble", "l_bound", "r_bound", F.explode(F.sequence("l_bound", "r_bound")).alias("first"))
    inside = spans.join(columns, ["chrom", "first"]).filter("last <= r_bound").select("chrom", "rid", "bubble")
    rows = reads.join(inside, ["chrom", "rid"]).select("chrom", "bubble", "rid", "snp_idx", "allele")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rid", "snp_idx"])
        first, alleles = pdf.snp_idx.tolist(), pdf.allele.tolist()
        ends = [0, *(np.flatnonzero(np.diff(pdf.rid.to_numpy())) + 1).tolist(), len(pdf)]
        own = [(first[a], alleles[a:b]) for a, b in zip(ends, ends[1:])]
        kept = covered(own, min(most, MOST_COVERAGE))
        mec = exact_mec(kept, int(pdf.snp_idx.min()), int(pdf.snp_idx.max()))
        return pd.DataFrame({"chrom": [pdf.chrom.iloc[0]], "bubble": [pdf.bubble.iloc[0]], "n_reads": [len(kept)], "mec": [mec]})

    return rows.groupBy("chrom", "bubble").applyInPandas(run, "chrom string, bubble long, n_reads long, mec long")


def bubble_reads(pairs: DataFrame, reads: DataFrame, areas: DataFrame) -> DataFrame:
    """(chrom, bubble, rid): reads with an allele on an ambiguous variant of an area; areas that one of them leaves go."""
    spans = reads.groupBy("chrom", "rid").agg(F.min("snp_idx").alias("first"), F.max("snp_idx").alias("last"))
    columns = areas.select("chrom", "bubble", "l_bound", "r_bound", F.explode(F.sequence("l_bound", "r_bound")).alias("snp_idx"))
    own = reads.filter("allele >= 0").join(pairs, ["chrom", "snp_idx"], "left_semi").join(columns, ["chrom", "snp_idx"])
    own = own.join(spans, ["chrom", "rid"]).select("chrom", "bubble", "rid", (F.col("first").between(F.col("l_bound"), F.col("r_bound")) & (F.col("last") <= F.col("r_bound"))).alias("within")).distinct()
    left = own.filter("NOT within").select("chrom", "bubble").distinct()
    return own.join(left, ["chrom", "bubble"], "left_anti").select("chrom", "bubble", "rid")


def mec_path(paths: DataFrame, reads: DataFrame) -> DataFrame:
    """(path, mec) of paths (chrom, path, snp_idx, bit): error correction of the reads that touch each; -1 if one leaves it."""
    touching = paths.join(reads.select("chrom", "rid", "snp_idx"), ["chrom", "snp_idx"]).select("chrom", "path", "rid").distinct()
    calls = touching.join(reads.filter("allele >= 0"), ["chrom", "rid"]).join(paths, ["chrom", "path", "snp_idx"], "left")
    each = calls.groupBy("path", "rid").agg(F.sum((F.col("allele") != F.col("bit")).cast("long")).alias("wrong"), F.count("*").alias("n"), F.max(F.col("bit").isNull()).alias("out"))
    return each.groupBy("path").agg(F.when(F.max("out"), -1).otherwise(F.sum(F.least("wrong", F.col("n") - F.col("wrong")))).cast("long").alias("mec"))


def matrix_view(reads: DataFrame) -> DataFrame:
    """(chrom, rid, first, calls): a read as text, '-' for a gap."""
    sign = F.when(F.col("allele") < 0, "-").otherwise(F.col("allele").cast("string"))
    rows = reads.groupBy("chrom", "rid").agg(F.min("snp_idx").alias("first"), F.array_sort(F.collect_list(F.struct("snp_idx", sign.alias("sign")))).alias("x"))
    return rows.select("chrom", "rid", "first", F.array_join(F.transform("x", lambda c: c["sign"]), "").alias("calls"))


def bubble_view(reads: DataFrame, areas: DataFrame) -> DataFrame:
    """(chrom, bubble, rid, row): the calls of each area's reads under each other, a column for each variant.

    areas: (chrom, bubble, l_bound, r_bound). A row begins with '-' if the read comes from the left of the
    area, else with a space, and ends with '-' if it goes on to the right; '-' between is a gap.
    """
    columns = areas.select("chrom", "bubble", "l_bound", "r_bound", F.explode(F.sequence("l_bound", "r_bound")).alias("snp_idx"))
    sign = F.when(F.col("allele") < 0, "-").otherwise(F.col("allele").cast("string"))
    own = reads.join(columns, ["chrom", "snp_idx"]).groupBy("chrom", "bubble", "l_bound", "r_bound", "rid").agg(F.min("snp_idx").alias("here"), F.array_sort(F.collect_list(F.struct("snp_idx", sign.alias("sign")))).alias("x"))
    spans = reads.groupBy("chrom", "rid").agg(F.min("snp_idx").alias("first"), F.max("snp_idx").alias("last"))
    front = F.when(F.col("first") < F.col("l_bound"), "-").otherwise(" ")
    behind = F.when(F.col("last") > F.col("r_bound"), "-").otherwise("")
    return own.join(spans, ["chrom", "rid"]).select("chrom", "bubble", "rid", F.concat(front, F.repeat(F.lit(" "), (F.col("here") - F.col("l_bound")).cast("int")), F.array_join(F.transform("x", lambda c: c["sign"]), ""), behind).alias("row"))


def snp_lower_bound(points: DataFrame, variants: DataFrame) -> DataFrame:
    """(chrom, point, snp_idx): for each point the first variant at or behind it, -1 without one. variants: (chrom, pos, snp_idx)."""
    rows = points.select("chrom", F.col("point").alias("at"), F.lit(0).alias("is_variant"), F.lit(None).cast("long").alias("snp_idx")).union(variants.select("chrom", F.col("pos").alias("at"), F.lit(1).alias("is_variant"), "snp_idx"))
    # From the last to the first: a frame that grows is carried along, one that shrinks is read anew for each row.
    ahead = W.partitionBy("chrom").orderBy(F.desc("at"), F.desc("is_variant"), F.desc("snp_idx")).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("found", F.last("snp_idx", True).over(ahead)).filter("is_variant = 0").select("chrom", F.col("at").alias("point"), F.coalesce("found", F.lit(-1).cast("long")).alias("snp_idx"))
