"""Haplotype blocks as walks through a graph in which every node has one way on that is taken.

From one rank to the next the ways are a map of words, and maps can be put together: each
bucket of ranks tells where every word that enters it comes out, a row for each
bucket and word joins these along a chromosome, and then each bucket writes down the walks that pass through it. No
task holds more than a bucket of ranks and the walks on it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import shuffled, stored

#: Ranks of a bucket.
RANKS = 1 << 14
OUT = -1


def _ways(k: int, ranks: int, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """For each rank of a bucket the word that each word leads to, OUT where it ends."""
    made = np.full((ranks, 1 << k), OUT, np.int64)
    order = np.argsort(-e)  # of two that leave a node the lesser stays
    s, e = s[order], e[order]
    made[s, e >> 1] = e & ((1 << k) - 1)
    return made


def haplotype_walks(edges: DataFrame, k: int, ranks: int = RANKS) -> DataFrame:
    """(chrom, block, snp_idx, phase) of every walk from a node that nothing reaches, up to complement; block is s * 2**k + w of its first node (s, w).

    edges: (chrom, s, e, weight). A walk begins where one edge leaves; of two it takes that with allele 0. Walks that meet go on together, and each has all of its variants.
    """
    live = edges.filter("weight > 0").select("chrom", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))
    mask = (1 << k) - 1
    reached = live.select("chrom", (F.col("s") + 1).alias("s"), F.col("e").bitwiseAND(mask).alias("w"))
    first = live.select("chrom", "s", F.shiftright("e", 1).alias("w")).filter(F.col("w") < 1 << (k - 1)).groupBy("chrom", "s", "w").count().filter("count = 1").drop("count").join(shuffled(reached), ["chrom", "s", "w"], "left_anti")
    bucket = F.floor(F.col("s") / ranks)
    none = F.lit(None).cast("long")
    rows = live.select("chrom", bucket.alias("bucket"), "s", "e", none.alias("block"), F.lit(False).alias("start")).unionByName(
        first.select("chrom", bucket.alias("bucket"), "s", F.col("w").alias("e"), (F.col("s") * (1 << k) + F.col("w")).alias("block"), F.lit(True).alias("start")))
    rows = stored(rows)

    def through(pdf: pd.DataFrame) -> pd.DataFrame:
        """Where each word, and each walk that begins here, leaves the bucket."""
        chrom, number = pdf.chrom.iloc[0], int(pdf.bucket.iloc[0])
        edge, start = pdf[~pdf.start], pdf[pdf.start]
        way = _ways(k, ranks, (edge.s - number * ranks).to_numpy(), edge.e.to_numpy())
        now = np.arange(1 << k)
        begun = {s: g for s, g in start.groupby("s")}
        walks, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for s in range(ranks):
            if (g := begun.get(s + number * ranks)) is not None:
                walks, at = np.append(walks, g.block.to_numpy()), np.append(at, g.e.to_numpy())
            now = np.where(now == OUT, OUT, way[s][now])
            at = way[s][at]
            walks, at = walks[at != OUT], at[at != OUT]
            if not len(at) and (now == OUT).all() and not any(t > s + number * ranks for t in begun):
                break
        maps = pd.DataFrame({"block": pd.array([None] * (1 << k), "Int64"), "entry": np.arange(1 << k), "out": now})
        own = pd.DataFrame({"block": pd.array(walks, "Int64"), "entry": -1, "out": at})
        return pd.concat([maps[maps.out != OUT], own]).assign(chrom=chrom, bucket=number)[["chrom", "bucket", "block", "entry", "out"]]

    maps = rows.groupBy("chrom", "bucket").applyInPandas(through, "chrom string, bucket long, block long, entry long, out long")

    def passed(pdf: pd.DataFrame) -> pd.DataFrame:
        """The words with which walks enter later buckets; a row for each bucket and word, and for each walk that leaves its bucket."""
        out, now = [], {}
        by = {n: g for n, g in pdf.groupby("bucket")}
        last = None
        for n in sorted(by):
            if last is not None and n != last + 1:  # no word comes through the bucket between
                out += [(pdf.chrom.iloc[0], last + 1, block, word) for block, word in now.items()]
                now = {}
            out += [(pdf.chrom.iloc[0], n, block, word) for block, word in now.items()]
            own = by[n]
            way = {int(a): int(b) for a, b, c in zip(own.entry, own.out, own.block.isna()) if c}
            now = {block: way[word] for block, word in now.items() if word in way}
            now |= {int(b): int(w) for b, w in zip(own.block, own.out) if not pd.isna(b)}
            last = n
        if now:
            out += [(pdf.chrom.iloc[0], last + 1, block, word) for block, word in now.items()]
        return pd.DataFrame(out, columns=["chrom", "bucket", "block", "e"])

    entries = maps.groupBy("chrom").applyInPandas(passed, "chrom string, bucket long, block long, e long")
    entries = entries.select("chrom", "bucket", (F.col("bucket") * ranks).alias("s"), "e", "block", F.lit(True).alias("start"))

    def written(pdf: pd.DataFrame) -> pd.DataFrame:
        """The alleles that each walk adds in this bucket; those of its first word are added where it begins."""
        number = int(pdf.bucket.iloc[0])
        edge, start = pdf[~pdf.start], pdf[pdf.start]
        way = _ways(k, ranks, (edge.s - number * ranks).to_numpy(), edge.e.to_numpy())
        blocks, snps, bits = [], [], []
        for block, s, w in zip(start.block.tolist(), start.s.tolist(), start.e.tolist()):
            if block == s * (1 << k) + w:
                blocks += [block] * k
                snps += range(s, s + k)
                bits += [w >> (k - 1 - j) & 1 for j in range(k)]
            s -= number * ranks
            while s < ranks and (w := int(way[s, w])) != OUT:
                blocks.append(block)
                snps.append(number * ranks + s + k)
                bits.append(w & 1)
                s += 1
        return pd.DataFrame({"chrom": pdf.chrom.iloc[0], "block": blocks, "snp_idx": snps, "phase": bits})

    return rows.unionByName(entries).groupBy("chrom", "bucket").applyInPandas(written, "chrom string, block long, snp_idx long, phase int")
