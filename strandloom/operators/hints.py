"""Which variants have a doubtful phase: 0 good, 1 low quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stored import shuffled

LEAST_DEPTH, SHARE_PERCENT, FIRST_THRESHOLD, MOST_DIFF = 5, 5, 5, 20


def all_pairs(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chrom, s, total, gap) of every two neighbouring variants; without a read both are 0."""
    every = sizes.select("chrom", F.explode(F.expr("CASE WHEN n_snp > 1 THEN sequence(0L, n_snp - 2) ELSE array() END")).alias("s"))
    return every.join(shuffled(pairs), ["chrom", "s"], "left").select("chrom", "s", F.coalesce(F.col("same") + F.col("diff"), F.lit(0)).alias("total"), F.coalesce(F.abs(F.col("same") - F.col("diff")), F.lit(0)).alias("gap"))


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select("chrom", F.explode(F.array("s", F.col("s") + 1)).alias("snp_idx")).distinct()


def low_depth_hint(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chrom, snp_idx) of the pairs that fewer than 5 reads cover."""
    return _both(all_pairs(pairs, sizes).filter(F.col("total") < LEAST_DEPTH))


def diff_threshold(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chrom, threshold): the greatest of 6 to 19 for which thin pairs and those with no greater gap stay under 5 % of the variants, else 5."""
    every = all_pairs(pairs, sizes)
    thin = every.groupBy("chrom").agg(F.sum((F.col("total") < LEAST_DEPTH).cast("long")).alias("thin"), *[F.sum((F.col("gap") <= d).cast("long")).alias(f"d{d}") for d in range(FIRST_THRESHOLD + 1, MOST_DIFF)])
    fits = [F.when((F.coalesce("thin", F.lit(0)) + F.coalesce(f"d{d}", F.lit(0))) * 100 < F.col("n_snp") * SHARE_PERCENT, d) for d in range(FIRST_THRESHOLD + 1, MOST_DIFF)]
    return sizes.join(thin, "chrom", "left").select("chrom", F.coalesce(F.greatest(*fits), F.lit(FIRST_THRESHOLD)).cast("long").alias("threshold"))


def low_diff_hint(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chrom, snp_idx) of the pairs whose gap is below the chromosome's threshold."""
    limits = diff_threshold(pairs, sizes)  # one row for each chromosome
    return _both(all_pairs(pairs, sizes).join(F.broadcast(limits), "chrom").filter(F.col("gap") < F.col("threshold")))


def hints(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chrom, snp_idx, hint): 1 for every doubtful variant."""
    return low_depth_hint(pairs, sizes).union(low_diff_hint(pairs, sizes)).distinct().withColumn("hint", F.lit(1))


def cumulative(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chrom, gap, up_to): pairs with at most that gap, for gaps 0 to 19."""
    every = all_pairs(pairs, sizes).filter(F.col("gap") < MOST_DIFF).groupBy("chrom", "gap").count()
    grid = sizes.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(MOST_DIFF - 1).cast("long"))).alias("gap"))
    along = W.partitionBy("chrom").orderBy("gap")
    return grid.join(every, ["chrom", "gap"], "left").select("chrom", "gap", F.sum(F.coalesce("count", F.lit(0))).over(along).alias("up_to"))


def hint_share(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chrom, percent): the share of a chromosome's variants that are doubtful."""
    found = hints(pairs, sizes).groupBy("chrom").agg(F.count("*").alias("n"))
    return sizes.join(found, "chrom", "left").select("chrom", (100.0 * F.coalesce("n", F.lit(0)) / F.col("n_snp")).alias("percent"))
