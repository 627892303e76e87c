"""Ready-made allele calls, and the graph as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import kmers
from strandloom.operators.reads import informative_reads


def allele_text(spark: SparkSession, path: str, variants: DataFrame, chrom: str | None = None) -> DataFrame:
    """(chrom, rid, snp_idx, allele) of a file whose lines are `name m (place allele) ...` for one chromosome.

    The first line, the number of reads, is skipped. Places count from 0 and
    must be those of variants; variants that a read skips become gaps. chrom has to
    be said if `variants` has several.
    """
    if chrom is not None:
        variants = variants.filter(F.col("chrom") == chrom)
    elif len(variants.select("chrom").distinct().limit(2).collect()) > 1:
        raise ValueError("the variants are on several chromosomes; say which one the calls are of")
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("rid"), F.split(F.trim("value"), r"\s+").alias("f")).filter(F.size("f") > 2)
    calls = rows.select("rid", F.posexplode(F.slice("f", 3, F.get("f", F.lit(1)).cast("int") * 2)).alias("k", "x"), "f").filter("k % 2 = 0")
    calls = calls.select("rid", (F.col("x").cast("int") + 1).alias("pos"), F.get("f", F.col("k") + 3).cast("int").alias("allele"))
    found = calls.join(variants.select("chrom", "pos", "snp_idx"), "pos", "left")
    checked = found.withColumn("snp_idx", F.when(F.col("snp_idx").isNull(), F.raise_error(F.concat(F.lit("no variant at "), F.col("pos"))).cast("long")).otherwise(F.col("snp_idx")))
    spans = checked.groupBy("chrom", "rid").agg(F.min("snp_idx").alias("a"), F.max("snp_idx").alias("b"))
    every = spans.select("chrom", "rid", F.explode(F.sequence("a", "b")).alias("snp_idx"))
    own = checked.select("chrom", "rid", "snp_idx", "allele").dropDuplicates(["chrom", "rid", "snp_idx"])
    return informative_reads(every.join(own, ["chrom", "rid", "snp_idx"], "left").na.fill(-1, ["allele"]))


def graph_rows(own: DataFrame, k: int, weights: DataFrame | None = None) -> DataFrame:
    """(chrom, s, node_u, node_v, cnt_u, cnt_v, weight): a graph's edges, nodes written as bits. All ranks are there."""
    weights = kmers.graph(own, k)[1] if weights is None else weights.select("chrom", "s", "e", "weight")
    ends = kmers.endpoints(weights, kmers.kmer_nodes(own, k), k)
    bits = lambda c: F.lpad(F.conv(F.col(c).cast("string"), 10, 2), k, "0")
    return ends.select("chrom", "s", bits("u").alias("node_u"), bits("v").alias("node_v"), "cnt_u", "cnt_v", "weight")


def graph_sink(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


