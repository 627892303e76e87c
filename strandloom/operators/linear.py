"""Bubbles that lie between linear flanks: an alternate to the areas of the island solver.

An edge is linear if it is the only one that leaves its first node and the only
one that reaches its second. How far linear edges go on from a node, at most 64,
is found for all nodes at once by doubling: each round joins every stretch to
the one that it leads to. A node where two edges leave behind a flank begins a bubble;
it ends at the first rank where all ways are back on flanks. Bubbles change
what later ones see, but only near them: they are solved in pieces of ranks that
begin some way before their own first rank, and what a piece finds changed where it begins has to be what the piece before
it leaves there. Pieces that differ are done again from farther back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import reads as _reads
from .stored import shuffled, stored

#: A flank's least and greatest length, ranks and paths that a bubble may have.
FLANK, MOST_FLANK, MOST_RANKS, MOST_PATHS = 10, 64, 30, 256
BACK, FORWARD = 0, 1
#: More ranks than a bubble reads or writes before and behind its first node.
BEFORE, BEHIND = MOST_FLANK + 16, MOST_FLANK + MOST_RANKS + 16
#: Ranks whose bubbles a task solves, and how many before them it begins at first.
PIECE, LEAD = 1 << 13, 1 << 10


def linear_edges(edges: DataFrame, k: int) -> DataFrame:
    """(chrom, s, u, v) of the edges (chrom, s, e, weight) that neither branch nor join."""
    live = edges.filter("weight > 0").select("chrom", "s", F.shiftright("e", 1).alias("u"), F.col("e").bitwiseAND((1 << k) - 1).alias("v"))
    alone = live.select("*", F.count("*").over(W.partitionBy("chrom", "s", "u")).alias("_out"), F.count("*").over(W.partitionBy("chrom", "s", "v")).alias("_in"))
    return alone.filter("_out = 1 AND _in = 1").drop("_out", "_in")


def flanks(edges: DataFrame, k: int) -> DataFrame:
    """(side, chrom, s, w, length, path): how far linear edges lead back (side 0) or forward (1) from each node, and the alleles there, from left to right.

    Of longer stretches the nearest 64 alleles.
    """
    own = linear_edges(edges, k)
    back = own.select(F.lit(BACK).alias("side"), "chrom", (F.col("s") + 1).alias("s"), F.col("v").alias("w"), F.col("u").alias("to"), F.shiftright("u", k - 1).cast("string").alias("path"))
    forward = own.select(F.lit(FORWARD).alias("side"), "chrom", "s", F.col("u").alias("w"), F.col("v").alias("to"), F.col("v").bitwiseAND(1).cast("string").alias("path"))
    now = stored(back.unionByName(forward).withColumn("length", F.lit(1)))
    there = F.when(F.col("side") == BACK, F.col("s") - F.col("length")).otherwise(F.col("s") + F.col("length"))
    for step in range(MOST_FLANK.bit_length() - 1):
        # Stretches that are not full have come to their end.
        full = F.col("length") == 1 << step
        far = now.select("side", "chrom", F.col("s").alias("at"), F.col("w").alias("to"), F.col("to").alias("far_to"), F.col("length").alias("more"), F.col("path").alias("far_path"))
        both = now.filter(full).withColumn("at", there).join(shuffled(far), ["side", "chrom", "at", "to"], "left")
        path = F.when(F.col("side") == BACK, F.concat(F.coalesce("far_path", F.lit("")), "path")).otherwise(F.concat("path", F.coalesce("far_path", F.lit(""))))
        longer = both.select("side", "chrom", "s", "w", F.coalesce("far_to", "to").alias("to"), path.alias("path"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"))
        now = stored(now.filter(~full).unionByName(longer))
    return now.select("side", "chrom", "s", "w", "length", "path")


def bubble_starts(edges: DataFrame, ends: DataFrame, k: int) -> DataFrame:
    """(chrom, s, w): nodes that two edges leave, up to complement, behind a flank of FLANK or more."""
    u = F.shiftright("e", 1)
    fork = edges.filter((F.col("weight") > 0) & (u < 1 << (k - 1))).groupBy("chrom", "s", u.alias("w")).count().filter("count = 2")
    return fork.join(shuffled(ends.filter((F.col("side") == BACK) & (F.col("length") >= FLANK))), ["chrom", "s", "w"], "left_semi").select("chrom", "s", "w")


class _Cluster:
    """The bubbles of one piece of ranks, solved from left to right.

    rows: (first variant, last variant, first variant that is told, alleles from there) of the reads; all of those that lie between a bubble's flanks are told.
    """

    def __init__(self, k: int, weight: dict[tuple[int, int], int], back: dict[tuple[int, int], str], forward: dict[tuple[int, int], str], rows: list[tuple[int, int, int, np.ndarray]]):
        self.k, self.mask, self.full = k, (1 << k) - 1, (2 << k) - 1
        self.weight, self.back, self.forward, self.rows = weight, back, forward, rows
        self.changed: dict[tuple[int, int], int] = {}
        self.seen: set[tuple[int, int]] = set()
        self.over: dict[int, list[int]] = {}
        for r, (_, _, told, row) in enumerate(rows):
            for at in np.flatnonzero(row >= 0).tolist():
                self.over.setdefault(told + at, []).append(r)

    def state(self, s: int) -> str:
        """All that bubbles from a rank on can see of those before it: weights that changed, and nodes that were looked at."""
        changed = sorted((*key, v) for key, v in self.changed.items() if key[0] >= s - BEFORE)
        return f"{changed} {sorted(key for key in self.seen if key[0] >= s)}"

    def out(self, s: int, w: int) -> list[int]:
        return [b for b in (0, 1) if self.weight.get((s, w << 1 | b), 0) > 0]

    def put(self, base: int, path: str, value: int) -> None:
        for j in range(len(path) - self.k):
            e = int(path[j : j + self.k + 1], 2)
            for word in (e, self.full - e):
                self.weight[base + j, word] = self.changed[base + j, word] = value

    def search(self, s: int, w: int) -> tuple[list[str], list[str]]:
        """The ways through the bubble, and those that end on the way; no ways if it doesn't close."""
        self.seen.add((s, w))
        ways, dead = [f"{w:0{self.k}b}"], []
        for rank in range(s + 1, s + MOST_RANKS + 1):
            longer = []
            for p in ways:
                node = int(p[-self.k :], 2)
                bits = self.out(rank - 1, node)
                self.seen.add((rank, (node << 1 | (0 not in bits)) & self.mask))
                longer += [p + str(b) for b in bits]
                if not bits:
                    dead.append(p)
            if not longer or len(longer) > MOST_PATHS:
                return [], dead
            ways = longer
            if all(len(self.forward.get((rank, int(p[-self.k :], 2)), "")) >= FLANK for p in ways):
                return ways, dead
        return [], dead

    def reads_on(self, s: int, ways: list[str], low: int, high: int) -> list[int]:
        """Reads with an allele where the ways disagree about neighbours; none if one of them reaches out of the flanks."""
        table = np.array([[int(c) for c in p] for p in ways])
        step = table[:, 1:] ^ table[:, :-1]
        both = step.any(0) & ~step.all(0)
        columns = np.flatnonzero(np.append(both, False) | np.insert(both, 0, False))
        found = sorted({r for c in columns.tolist() for r in self.over.get(s + c, ())})
        inside = all(self.rows[r][0] >= low and self.rows[r][1] < high for r in found)
        return found if inside else []

    def solve(self, s: int, w: int) -> tuple[int, int, int, int, str] | None:
        """(variants, ways, reads, errors, path) of the bubble that begins here, if there is one."""
        if (s, w) in self.seen or len(self.out(s, w)) != 2:
            return None
        ways, dead = self.search(s, w)
        if not ways:
            return None
        before, length = self.back[s, w], len(ways[0])
        rank = s + length - self.k
        whole = [before + p + self.forward[rank, int(p[-self.k :], 2)] for p in ways]
        base = s - len(before)
        if any(self.weight.get((base + j, int(p[j : j + self.k + 1], 2)), 0) <= 0 for p in whole for j in range(len(p) - self.k)):
            return None  # a bubble before this one has taken its flank
        for p in dead:
            self.put(s, p, 0)
        found = self.reads_on(s, ways, base, min(base + min(map(len, whole)), s + length + 2 * MOST_FLANK))
        if not found:
            return None
        cost = []
        for p in whole:
            bits, errors = np.array([int(c) for c in p]), 0
            for _, _, told, row in (self.rows[r] for r in found):
                called = row >= 0
                wrong = int((bits[told - base : told - base + len(row)][called] != row[called]).sum())
                errors += min(wrong, int(called.sum()) - wrong)
            cost.append(errors)
        best = int(np.argmin(cost))
        for p in whole:
            self.put(base, p, 0)
        self.put(base, whole[best], 1)
        return length, len(ways), len(found), cost[best], whole[best]


def _pieces(reads: DataFrame, edges: DataFrame, ends: DataFrame, starts: DataFrame, k: int, lead: int, only: DataFrame | None = None) -> DataFrame:
    """(chrom, piece, kind, s, w, value, length, ways, n_reads, base, path) of pieces of PIECE ranks that begin `lead` ranks before their own.

    Bubbles ("bubble") that begin in a piece, changed weights ("edge") of the ranks that no bubble of a later piece can
    change and one of its own can, and what it found changed at its first rank ("left") and leaves behind its last ("right").

    only: the pieces (chrom, piece) that are asked for.
    """
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    # A piece has what a bubble before it may have changed there, also where it begins behind that bubble.
    reach = max(lead, BEFORE + BEHIND)

    def held(first, last):
        """The pieces that read what reaches from a variant or rank to another one."""
        return F.explode(F.sequence(F.greatest(F.floor((first - BEHIND) / PIECE), F.lit(0)), F.floor((last + reach + BEFORE) / PIECE))).alias("piece")

    s = F.col("s")
    wanted = starts.select("chrom", F.explode(F.sequence(F.floor(s / PIECE), F.floor((s + reach) / PIECE))).alias("piece")).distinct()
    if only is not None:
        wanted = wanted.join(F.broadcast(only), ["chrom", "piece"], "left_semi")
    # One row at most for PIECE ranks.
    wanted = F.broadcast(wanted)

    def rows(table: DataFrame, kind, a, b, c=none, path=text, last=None) -> DataFrame:
        """What pieces read, from `b` (of reads and calls) or `a` on."""
        at = a if last is None else b
        placed = table.select("chrom", held(at, at if last is None else last), kind.alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c"), path.alias("path"))
        return placed.join(wanted, ["chrom", "piece"], "left_semi")

    own = rows(_reads.read_spans(reads), F.lit("span"), F.col("rid"), F.col("first"), F.col("last"), last=F.col("last"))
    own = own.unionByName(rows(reads, F.lit("call"), F.col("rid"), F.col("snp_idx"), F.col("allele"), last=F.col("snp_idx")))
    own = own.unionByName(rows(edges, F.lit("edge"), s, F.col("e"), F.col("weight")))
    own = own.unionByName(rows(ends, F.when(F.col("side") == BACK, "back").otherwise("forward"), s, F.col("w"), path=F.col("path")))
    own = own.unionByName(rows(starts, F.lit("start"), s, F.col("w")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chrom, piece = pdf.chrom.iloc[0], int(pdf.piece.iloc[0])
        begin, end = piece * PIECE, (piece + 1) * PIECE
        kinds = {kind: part for kind, part in pdf.groupby("kind")}
        pick = lambda kind, value: {(a, b): v for a, b, v in kinds[kind][["a", "b", value]].itertuples(index=False)} if kind in kinds else {}
        told = []
        if "call" in kinds:
            call = kinds["call"].sort_values(["a", "b"])
            span = kinds["span"].set_index("a")
            rid, snps, alleles = call.a.to_numpy(), call.b.to_numpy(), call.c.to_numpy(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(rid)) + 1).tolist(), len(call)]
            span = span.loc[rid[cuts[:-1]]]
            for a, b, first, last in zip(cuts, cuts[1:], span.b.tolist(), span.c.astype("int64").tolist()):
                row = np.full(snps[b - 1] - snps[a] + 1, -1, np.int64)
                row[snps[a:b] - snps[a]] = alleles[a:b]
                told.append((int(first), int(last), int(snps[a]), row))
        cluster = _Cluster(k, {key: int(v) for key, v in pick("edge", "c").items()}, pick("back", "path"), pick("forward", "path"), told)
        out, found = [], None
        for a, b in sorted(zip(kinds["start"].a.tolist(), kinds["start"].b.tolist())):
            if not begin - lead <= a < end:
                continue
            if a >= begin and found is None:
                found = cluster.state(begin)
            if (made := cluster.solve(a, b)) and a >= begin:
                length, ways, n, mec, path = made
                out.append((chrom, piece, "bubble", a, b, mec, length, ways, n, a - len(cluster.back[a, b]), path))
        nothing = [None] * 7
        out += [(chrom, piece, "edge", a, b, v, *nothing[:4], None) for (a, b), v in cluster.changed.items() if begin - BEFORE <= a < end - BEFORE]
        out += [(chrom, piece, kind, *nothing, state) for kind, state in (("left", cluster.state(begin) if found is None else found), ("right", cluster.state(end)))]
        columns = ["chrom", "piece", "kind", "s", "w", "value", "length", "ways", "n_reads", "base", "path"]
        return pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in columns[3:10]})

    return own.groupBy("chrom", "piece").applyInPandas(run, "chrom string, piece long, kind string, s long, w long, value long, length long, ways long, n_reads long, base long, path string")


def topology_bubbles(reads: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The graph (chrom, s, e, weight) with its small bubbles solved, and the bubbles (chrom, s, w, length, ways, n_reads, mec, base, path).

    A bubble has at most 30 ranks and 256 ways. Of the ways the one of least
    error correction stays, with weight 1, at equal ones the first; flanks count, from `base` on. Ways that end within a
    closed bubble go. A bubble is left as it is if a read on it reaches out of
    its flanks, if none lies on it, or if one before it has taken its flank.
    """
    edges = stored(edges.filter("weight > 0").select("chrom", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), F.col("weight").cast("long").alias("weight")))
    ends = stored(flanks(edges, k).withColumn("w", F.col("w").cast("long")))
    starts = stored(bubble_starts(edges, ends, k))
    made, lead = stored(_pieces(reads, edges, ends, starts, k, LEAD)), LEAD
    while True:
        left = made.filter("kind = 'left'").select("chrom", "piece", F.col("path").alias("found"))
        right = made.filter("kind = 'right'").select("chrom", (F.col("piece") + 1).alias("piece"), F.col("path").alias("left"))
        # The first piece of a chromosome is right, and so is each one that found what a right one left. Nothing begins in a piece that isn't there.
        again = stored(left.join(right, ["chrom", "piece"], "left").filter(F.col("found") != F.coalesce("left", F.lit("[] []"))).select("chrom", "piece"))
        if again.isEmpty():
            break
        lead *= 4
        redone = stored(_pieces(reads, edges, ends, starts, k, lead, again))
        made = made.join(F.broadcast(again), ["chrom", "piece"], "left_anti").unionByName(redone)
    changed = made.filter("kind = 'edge'").select("chrom", "s", F.col("w").alias("e"), F.col("value").alias("new"))
    after = edges.join(shuffled(changed), ["chrom", "s", "e"], "left").select("chrom", "s", "e", F.coalesce("new", "weight").alias("weight")).filter("weight > 0")
    return after, made.filter("kind = 'bubble'").select("chrom", "s", "w", "length", "ways", "n_reads", F.col("value").alias("mec"), "base", "path")


def default_errors(found: DataFrame, reads: DataFrame, blocks: DataFrame) -> DataFrame:
    """Bubbles (chrom, s, w, mec, base, path, length) with the errors that other blocks (chrom, block, snp_idx, phase) make on the same reads.

    (chrom, s, w, n_inside, mec, block_mec): of the reads that lie within a
    bubble's path and touch its middle, those that are inside one of the blocks; their errors by the path and by that block.
    """
    spans = _reads.read_spans(reads)
    middle = found.select("chrom", "s", "w", "base", (F.col("base") + F.length("path") - 1).alias("end"), (F.col("s") + F.col("length") - 1).alias("last_in"), F.explode(F.sequence("s", F.col("s") + F.col("length") - 1)).alias("snp_idx"))
    on = reads.filter("allele >= 0").join(shuffled(middle), ["chrom", "snp_idx"]).join(shuffled(spans), ["chrom", "rid"]).filter("first >= base AND last <= end").select("chrom", "s", "w", "rid").distinct()
    path = found.select("chrom", "s", "w", F.posexplode(F.split("path", "")).alias("j", "bit"), "base").select("chrom", "s", "w", (F.col("base") + F.col("j")).alias("snp_idx"), F.col("bit").cast("int").alias("bit"))
    calls = reads.filter("allele >= 0").join(shuffled(on), ["chrom", "rid"]).join(shuffled(path), ["chrom", "s", "w", "snp_idx"])
    both = calls.join(shuffled(blocks.select("chrom", "block", "snp_idx", "phase")), ["chrom", "snp_idx"], "left")
    each = both.groupBy("chrom", "s", "w", "rid").agg(F.count_distinct("block").alias("blocks"), F.count_if(F.col("block").isNull()).alias("bare"), F.count("*").alias("n"), F.count_if(F.col("allele") != F.col("bit")).alias("a"), F.count_if(F.col("allele") != F.col("phase")).alias("b"))
    least = lambda c: F.sum(F.least(c, F.col("n") - F.col(c)))
    return each.filter("blocks = 1 AND bare = 0").groupBy("chrom", "s", "w").agg(F.count("*").alias("n_inside"), least("a").alias("mec"), least("b").alias("block_mec"))
