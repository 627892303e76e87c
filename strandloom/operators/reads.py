"""Reads as rows of allele calls: (chrom, rid, snp_idx, allele), -1 for a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

READ = ["chrom", "rid"]
#: Variants of a chromosome that one task orders.
BUCKET = 1 << 14


def gap_trim(alleles: DataFrame) -> DataFrame:
    """Drop the gap calls before a read's first and after its last allele."""
    own = W.partitionBy(*READ)
    called = F.when(F.col("allele") >= 0, F.col("snp_idx"))
    marked = alleles.select("*", F.min(called).over(own).alias("_first"), F.max(called).over(own).alias("_last"))
    return marked.filter(F.col("snp_idx").between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def informative_reads(alleles: DataFrame, least: int = 2) -> DataFrame:
    """Trimmed reads that keep at least two calls, gaps inside counted."""
    return gap_trim(alleles).withColumn("_n", F.count("*").over(W.partitionBy(*READ))).filter(F.col("_n") >= least).drop("_n")


def allele_totals(alleles: DataFrame) -> DataFrame:
    """Per chromosome the calls that are no gaps, all calls, and the reads."""
    return alleles.groupBy("chrom").agg(F.sum((F.col("allele") >= 0).cast("long")).alias("alleles"), F.count("*").alias("calls"), F.countDistinct("rid").alias("reads"))


def read_spans(reads: DataFrame) -> DataFrame:
    """(chrom, rid, first, last): the variants that each read reaches."""
    return reads.groupBy(*READ).agg(F.min("snp_idx").alias("first"), F.max("snp_idx").alias("last"))


def variant_counts(reads: DataFrame) -> DataFrame:
    """(chrom, n_snp): variants are numbered from 0 to the last that a read reaches."""
    return reads.groupBy("chrom").agg((F.max("snp_idx") + 1).alias("n_snp"))


def coverage_islands(reads: DataFrame) -> DataFrame:
    """(chrom, snp_idx, island): runs of variants whose neighbours some read spans; island is the run's first variant."""
    return runs(read_spans(reads)).select("chrom", F.explode(F.sequence("island", "last")).alias("snp_idx"), "island")


def runs(spans: DataFrame) -> DataFrame:
    """(chrom, island, last): the first and last variant of every run of spans (chrom, first, last) that share a variant, one with the next.

    Spans are counted in where they begin and out where they end, so that the
    ordered pass goes over variants and not over spans.
    """
    steps = spans.select("chrom", F.inline(F.array(F.struct(F.col("first").alias("snp_idx"), F.lit(1).alias("d")), F.struct(F.col("last").alias("snp_idx"), F.lit(-1).alias("d")))))
    here = steps.groupBy("chrom", "snp_idx").agg(F.sum("d").alias("d")).withColumn("bucket", F.floor(F.col("snp_idx") / BUCKET))
    opened = carried(here, "d", F.sum).withColumn("new", F.when(F.col("carried") == F.col("d"), F.col("snp_idx"))).drop("carried")
    return carried(opened, "new", F.max).groupBy("chrom", F.col("carried").alias("island")).agg(F.max("snp_idx").alias("last"))


def carried(rows: DataFrame, column: str, how) -> DataFrame:
    """rows with `carried`: the running F.sum or F.max of a column along each chromosome's variants.

    It runs within buckets of variants, and from one to the next over a row for
    each bucket, so that a chromosome is as many tasks as it has buckets.
    """
    inside = W.partitionBy("chrom", "bucket").orderBy("snp_idx")
    before = W.partitionBy("chrom").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ends = rows.groupBy("chrom", "bucket").agg(how(column).alias("_whole"))
    ends = ends.select("chrom", "bucket", how("_whole").over(before).alias("_before"))
    both = rows.withColumn("_inside", how(column).over(inside)).join(F.broadcast(ends), ["chrom", "bucket"])
    if how is F.sum:
        value = F.coalesce("_inside", F.lit(0)) + F.coalesce("_before", F.lit(0))
    else:
        value = F.greatest("_inside", "_before")  # nulls count for nothing
    return both.withColumn("carried", value).drop("_inside", "_before")


def adjacent_reads(reads: DataFrame) -> DataFrame:
    """(chrom, snp_idx, rid): reads with a call, gaps counted, on a variant and on the one before it."""
    before = F.lag("snp_idx").over(W.partitionBy(*READ).orderBy("snp_idx"))
    return reads.withColumn("_before", before).filter(F.col("_before") == F.col("snp_idx") - 1).select("chrom", "snp_idx", "rid")


def bin_overlap(spans: DataFrame, points: DataFrame, width: int = 1 << 14) -> DataFrame:
    """Spans (chrom, start, end; end excluded) joined to the points (chrom, pos) inside them.

    Both sides get the bins that they touch and are joined on those; a span's
    bins are few because its length is bounded by a read's.
    """
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    return binned.filter("end > start").join(points.withColumn("_bin", F.floor(F.col("pos") / width)), ["chrom", "_bin"]).filter("start <= pos AND pos < end").drop("_bin")
