"""Where the graph is undecided: pairs of variants that it phases both ways, and the areas around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .reads import adjacent_reads, read_spans
from .stored import shuffled


def ambiguous_pairs(weights: DataFrame, k: int) -> DataFrame:
    """(chrom, snp_idx): variants whose phase against the one before is both equal and unequal among the edges."""
    live = weights.filter((F.col("weight") > 0) & (F.col("e") < (1 << k)))
    each = live.select("chrom", "s", "e", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("j"))
    bits = F.expr(f"shiftright(e, {k} - j) & 3")
    seen = each.select("chrom", (F.col("s") + F.col("j")).alias("snp_idx"), F.when(bits.isin(0, 3), 1).otherwise(2).alias("kind"))
    return seen.groupBy("chrom", "snp_idx").agg(F.bit_or("kind").alias("kinds")).filter("kinds = 3").select("chrom", "snp_idx")


def bubble_bounds(pairs: DataFrame, reads: DataFrame) -> DataFrame:
    """(chrom, snp_idx, l_bound, r_bound): what the reads over each ambiguous pair reach."""
    over = adjacent_reads(reads).join(shuffled(pairs), ["chrom", "snp_idx"], "left_semi")
    return over.join(shuffled(read_spans(reads)), ["chrom", "rid"]).groupBy("chrom", "snp_idx").agg(F.min("first").alias("l_bound"), F.max("last").alias("r_bound"))


def bubble_pairs(bounds: DataFrame) -> DataFrame:
    """`bubble_bounds` with the number of each pair's bubble: one ends where the next pair's reads begin behind its last pair."""
    along = W.partitionBy("chrom").orderBy("snp_idx")
    new = F.when(F.col("l_bound") > F.lag("snp_idx").over(along), 1).otherwise(0)
    return bounds.withColumn("_new", new).withColumn("bubble", F.sum("_new").over(along)).drop("_new")


def bubble_segments(bounds: DataFrame) -> DataFrame:
    """(chrom, bubble, l_bound, r_bound, n_pairs) of the bubbles of `bubble_pairs`."""
    return bubble_pairs(bounds).groupBy("chrom", "bubble").agg(F.min("l_bound").alias("l_bound"), F.max("r_bound").alias("r_bound"), F.count("*").alias("n_pairs"))
