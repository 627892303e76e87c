"""Allele calls from aligned reads: which of a variant's two bases a read shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.align import edit_distance_pair
from strandloom.functions.cigar import allele_call, base_code, cigar_spans, query_pos
from strandloom.sources.fasta import CHUNK

from .reads import bin_overlap, informative_reads

#: Fixed value: bases on each side of a variant that are compared.
AROUND = 15


def windows(variants: DataFrame, chunks: DataFrame) -> DataFrame:
    """Variants with ref_window and alt_window: the reference around each, as it is and with the other base.

    A variant on a contig that the reference lacks, or behind its end, is an error.
    """
    at = variants.select("chrom", "snp_idx", "pos", "alt", F.floor((F.col("pos") - 1) / CHUNK).cast("int").alias("chunk"))
    missing = F.raise_error(F.concat(F.lit("no reference at "), F.col("chrom"), F.lit(":"), F.col("pos").cast("string"))).cast("string")
    own = at.join(chunks, ["chrom", "chunk"], "left").withColumn("seq", F.when(F.col("seq").isNull() | (F.col("pos") > F.col("length")), missing).otherwise(F.col("seq")))
    left = F.greatest(F.col("pos") - 1 - AROUND, F.lit(0))
    right = F.least(F.col("pos") + AROUND, F.col("length"))
    text = base_code(F.substring("seq", (left - F.col("begin") + 1).cast("int"), (right - left).cast("int")))
    own = own.withColumn("ref_window", text).withColumn("_k", (F.col("pos") - left).cast("int"))
    changed = F.concat(F.substring("ref_window", F.lit(1), F.col("_k") - 1), base_code(F.col("alt")), F.expr("substring(ref_window, _k + 1)"))
    return own.select("chrom", "snp_idx", "pos", "ref_window", changed.alias("alt_window"))


def detect_alleles(alignments: DataFrame, variants: DataFrame, chunks: DataFrame, strict: bool = False, least_mapq: int = 0, skip_flags: int = 0) -> DataFrame:
    """(chrom, rid, snp_idx, que_pos, allele) of the informative reads.

    Every alignment counts, whatever its flags and quality, unless least_mapq or
    skip_flags say otherwise. Reads without bases are left out.
    """
    kept = alignments.filter((F.col("mapq") >= least_mapq) & (F.col("flag").bitwiseAND(F.lit(skip_flags)) == 0) & (F.length("seq") > 0) & (F.col("seq") != "*"))
    spans = kept.withColumn("start", F.col("pos0") + 1).withColumn("end", F.col("start") + cigar_spans(F.col("cigar"), strict)["ref_len"])
    met = bin_overlap(spans, windows(variants, chunks))
    met = met.withColumn("que_pos", query_pos(F.col("cigar"), F.col("start"), F.col("pos"), strict))
    left = F.greatest(F.col("que_pos") - AROUND, F.lit(0))
    right = F.least(F.col("que_pos") + AROUND + 1, F.length("seq"))
    own = base_code(F.substring("seq", (left + 1).cast("int"), (right - left).cast("int")))
    both = edit_distance_pair(F.col("_own"), F.col("ref_window"), F.col("alt_window"))
    called = met.withColumn("_own", own).withColumn("allele", allele_call(both["to_ref"], both["to_alt"]))
    return informative_reads(called.select("chrom", "rid", "snp_idx", F.col("que_pos").cast("int").alias("que_pos"), "allele"))
