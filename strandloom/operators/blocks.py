"""Haplotype blocks as rows (chrom, block, snp_idx, phase), and what reads say about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .reads import BUCKET, read_spans
from .stored import shuffled

BROKE, KEPT, REVERSE = -1, 0, 1


def majority_blocks(reads: DataFrame, pairs: DataFrame) -> DataFrame:
    """Blocks from the majority of reads for each two neighbours; a tie begins a new block, named after its first variant."""
    first = reads.select("chrom", "snp_idx").distinct()
    step = first.join(pairs.select("chrom", (F.col("s") + 1).alias("snp_idx"), "same", "diff"), ["chrom", "snp_idx"], "left")
    along = W.partitionBy("chrom").orderBy("snp_idx")
    tie = F.coalesce(F.col("same") == F.col("diff"), F.lit(True))
    step = step.withColumn("block", F.max(F.when(tie, F.col("snp_idx"))).over(along))
    turns = F.sum(F.when(tie, 0).otherwise((F.col("diff") > F.col("same")).cast("int"))).over(W.partitionBy("chrom", "block").orderBy("snp_idx"))
    return step.select("chrom", "block", "snp_idx", (turns % 2).cast("int").alias("phase"))


def bounds(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("chrom", "block").agg(F.min("snp_idx").alias("first_snp"), F.max("snp_idx").alias("last_snp"))


def shadow_blocks(spans: DataFrame) -> DataFrame:
    """Spans (chrom, block, first_snp, last_snp) that no block before them, from left to right and long ones first, already reaches past."""
    before = W.partitionBy("chrom").orderBy("first_snp", F.desc("last_snp"), "block").rowsBetween(W.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max("last_snp").over(before)).filter(F.col("_reach").isNull() | (F.col("last_snp") > F.col("_reach"))).drop("_reach")


def _inside(reads: DataFrame, blocks: DataFrame) -> DataFrame:
    """(chrom, block, rid, snp_idx, wrong) of the calls of reads that lie wholly in a block; wrong is null on a gap."""
    spans = read_spans(reads)
    at_first = blocks.select("chrom", "block", F.col("snp_idx").alias("first"))
    own = spans.join(at_first, ["chrom", "first"]).join(bounds(blocks), ["chrom", "block"]).filter(F.col("last") <= F.col("last_snp"))
    calls = reads.join(own.select("chrom", "block", "rid"), ["chrom", "rid"])
    return calls.join(blocks, ["chrom", "block", "snp_idx"]).select("chrom", "block", "rid", "snp_idx", F.when(F.col("allele") >= 0, (F.col("allele") != F.col("phase")).cast("long")).alias("wrong"))


def _delta(reads: DataFrame, blocks: DataFrame, new) -> DataFrame:
    """Errors over each pivot, as they are and with `new`, of running and whole sums over each read's calls."""
    own = W.partitionBy("chrom", "block", "rid")
    along = own.orderBy("snp_idx")
    called = F.col("wrong").isNotNull().cast("long")
    rows = _inside(reads, blocks).withColumn("called", called).withColumn("wrong", F.coalesce("wrong", F.lit(0)))
    sums = rows.select("*", F.sum("wrong").over(own).alias("old"), F.sum("called").over(own).alias("n"), F.sum("wrong").over(along).alias("wrong_here"), F.sum("called").over(along).alias("n_here"))
    sums = sums.withColumn("new", new)
    return sums.groupBy("chrom", "block", F.col("snp_idx").alias("pivot")).agg(F.sum(F.least("old", F.col("n") - F.col("old"))).alias("old_mec"), F.sum(F.least("new", F.col("n") - F.col("new"))).alias("new_mec"))


def mec_switch_delta(reads: DataFrame, blocks: DataFrame) -> DataFrame:
    """(chrom, block, pivot, old_mec, new_mec): errors of the reads over a pivot, as it is and with all behind it reversed."""
    behind = F.col("n") - F.col("n_here") - (F.col("old") - F.col("wrong_here"))
    return _delta(reads, blocks, F.col("wrong_here") + behind)


def mec_flip_delta(reads: DataFrame, blocks: DataFrame) -> DataFrame:
    """The same with only the pivot reversed."""
    return _delta(reads, blocks, F.col("old") + F.col("called") - 2 * F.col("wrong"))


def block_order(blocks: DataFrame) -> DataFrame:
    """(chrom, block, before, p_first, p_last, c_first, c_last): each block with the one before it."""
    along = W.partitionBy("chrom").orderBy("first_snp", "block")
    own = bounds(blocks)
    return own.select("chrom", "block", F.lag("block").over(along).alias("before"), F.lag("first_snp").over(along).alias("p_first"), F.lag("last_snp").over(along).alias("p_last"), F.col("first_snp").alias("c_first"), F.col("last_snp").alias("c_last"))


def block_connect(reads: DataFrame, blocks: DataFrame) -> DataFrame:
    """(chrom, block, before, kept_mec, reverse_mec, state) of neighbouring blocks; state -1 broke, 0 kept, 1 reverse.

    Reads count that touch the end of the one block or the start of the other,
    reach both, stay within them, and have alleles in both. A tie breaks.
    """
    order = block_order(blocks).filter(F.col("before").isNotNull())
    ends = order.select("*", F.explode(F.array_distinct(F.array("p_last", "c_first"))).alias("snp_idx"))
    touch = reads.select("chrom", "rid", "snp_idx").join(shuffled(ends), ["chrom", "snp_idx"]).drop("snp_idx").distinct()
    cross = touch.join(shuffled(read_spans(reads)), ["chrom", "rid"]).filter("first >= p_first AND last <= c_last AND last >= c_first AND first <= p_last")
    calls = cross.drop("first", "last").join(shuffled(reads.filter("allele >= 0")), ["chrom", "rid"])
    calls = calls.withColumn("of", F.when(F.col("snp_idx") <= F.col("p_last"), F.col("before")).when(F.col("snp_idx") >= F.col("c_first"), F.col("block")))
    phases = blocks.select("chrom", F.col("block").alias("of"), "snp_idx", "phase")
    calls = calls.join(shuffled(phases), ["chrom", "of", "snp_idx"]).select("chrom", "block", "before", "rid", (F.col("of") == F.col("before")).alias("left"), (F.col("allele") == F.col("phase")).cast("long").alias("hit"))
    each = calls.groupBy("chrom", "block", "before", "rid").agg(
        F.sum(F.when(F.col("left"), F.col("hit"))).alias("left_hits"), F.sum(F.when(~F.col("left"), F.col("hit"))).alias("right_hits"),
        F.count(F.when(F.col("left"), 1)).alias("n_left"), F.count(F.when(~F.col("left"), 1)).alias("n_right"),
    ).filter("n_left > 0 AND n_right > 0")
    n = F.col("n_left") + F.col("n_right")
    kept = F.col("left_hits") + F.col("right_hits")
    reverse = F.col("left_hits") + F.col("n_right") - F.col("right_hits")
    sums = each.groupBy("chrom", "block").agg(F.sum(F.least(kept, n - kept)).alias("kept_mec"), F.sum(F.least(reverse, n - reverse)).alias("reverse_mec"))
    state = F.when(F.col("kept_mec") > F.col("reverse_mec"), REVERSE).when(F.col("kept_mec") < F.col("reverse_mec"), KEPT).otherwise(BROKE)
    return order.select("chrom", "block", "before").join(sums, ["chrom", "block"], "left").na.fill(0, ["kept_mec", "reverse_mec"]).withColumn("state", state)


def _groups(blocks: DataFrame, connections: DataFrame) -> DataFrame:
    """(chrom, block, first_snp, last_snp, group, ps_idx, turned): `block_merge` with each block's bounds and the first variant of its group."""
    along = W.partitionBy("chrom").orderBy("first_snp", "block")
    own = bounds(blocks).join(connections.select("chrom", "block", "state"), ["chrom", "block"], "left").withColumn("state", F.coalesce("state", F.lit(BROKE)))
    new = F.col("state") == BROKE
    own = own.withColumn("group", F.last(F.when(new, F.col("block")), True).over(along)).withColumn("ps_idx", F.last(F.when(new, F.col("first_snp")), True).over(along)).withColumn("_run", F.sum(new.cast("int")).over(along))
    turned = F.sum((F.col("state") == REVERSE).cast("int")).over(W.partitionBy("chrom", "_run").orderBy("first_snp", "block"))
    return own.select("chrom", "block", "first_snp", "last_snp", "group", "ps_idx", (turned % 2).cast("int").alias("turned"))


def block_merge(blocks: DataFrame, connections: DataFrame) -> DataFrame:
    """(chrom, block, group, turned): blocks that belong together under the name of their first, and whether each is reversed."""
    return _groups(blocks, connections).select("chrom", "block", "group", "turned")


def merged_phases(blocks: DataFrame, connections: DataFrame) -> DataFrame:
    """(chrom, snp_idx, ps_idx, phase): every variant's merged block, by its first variant, and phase.

    Where two blocks hold a variant, the later one decides. A block may be as long as a chromosome: its variants meet its group bucket by bucket.
    """
    bucket = lambda c: F.floor(c / BUCKET)
    parts = _groups(blocks, connections).select("chrom", "block", "ps_idx", "turned", F.explode(F.sequence(bucket(F.col("first_snp")), bucket(F.col("last_snp")))).alias("bucket"))
    own = blocks.withColumn("bucket", bucket(F.col("snp_idx"))).join(shuffled(parts), ["chrom", "block", "bucket"])
    last = own.groupBy("chrom", "snp_idx").agg(F.max(F.struct("block", "ps_idx", F.col("phase").bitwiseXOR(F.col("turned")).alias("phase"))).alias("x"))
    return last.select("chrom", "snp_idx", "x.ps_idx", "x.phase")
