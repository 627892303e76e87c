"""Command line: phase the variants of a VCF file."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandloom.operators import calls, kmers, reads, solver
from strandloom.plans import phasing
from strandloom.operators.stored import stored
from strandloom.sources import alignments, alleles, fasta, vcf


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="strandloom", description="Phase heterozygous variants by the reads that cover them.")
    p.add_argument("-b", "--reads", help="aligned reads, .bam or .sam")
    p.add_argument("-v", "--variants", required=True, help="variants, .vcf or .vcf.gz")
    p.add_argument("-r", "--reference", help="the reference, FASTA")
    p.add_argument("-R", "--alleles", help="ready-made allele calls instead of reads")
    p.add_argument("-o", "--output", required=True, help="folder of the phased lines")
    p.add_argument("-c", "--chromosome", help="phase this one only")
    p.add_argument("-k", type=int, default=phasing.DEFAULT_K, help="k-mer size, 2 to 5")
    p.add_argument("-l", "--graph", help="folder for the graph after each step")
    p.add_argument("--timers", action="store_true", help="print the seconds that the steps took, and the processor seconds of their tasks in Java")
    got = p.parse_args(argv)
    if not got.alleles and not (got.reads and got.reference):
        p.error("reads and a reference are needed, or allele calls")
    if got.k not in phasing.ALLOWED_K:
        print(f"k must be from 2 to 5; {phasing.DEFAULT_K} is used", file=sys.stderr)
        got.k = phasing.DEFAULT_K
    return got


def processor(spark: SparkSession) -> float:
    """Processor seconds of the Java side of all tasks so far, as Spark's status store has them (it keeps the last stages, 1000 unless set)."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).executorCpuTime() for k in range(stages.size())) / 1e9


def main(argv: list[str] | None = None) -> int:
    got = arguments(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    times = {}

    def timed(name, step):
        began, used = time.perf_counter(), processor(spark)
        made = step()
        times[name] = time.perf_counter() - began, processor(spark) - used
        return made

    table = timed("variants", lambda: stored(vcf.variants(spark, got.variants, got.chromosome)))
    head = vcf.header(spark, got.variants)
    if (n := vcf.samples(head)) != 1:
        print(f"the file has {n} samples; the first is phased", file=sys.stderr)
    if got.alleles:
        found = alleles.allele_text(spark, got.alleles, table, got.chromosome)
    else:
        aligned = alignments.bam(spark, got.reads, got.chromosome) if got.reads.endswith(".bam") else alignments.sam(spark, got.reads)
        if got.chromosome:
            aligned = aligned.filter(F.col("chrom") == got.chromosome)
        found = calls.detect_alleles(aligned, table, fasta.chunks(spark, got.reference)).drop("que_pos")
    found = timed("alleles", lambda: stored(found))
    sizes = table.groupBy("chrom").agg((F.max("snp_idx") + 1).alias("n_snp"))
    own = timed("reads", lambda: stored(reads.informative_reads(found)))
    graph_stages = ("tips", "bubbles") if got.graph else ()
    solved = timed("graph", lambda: stored(solver.solve_stages(own, got.k, (*graph_stages, "joined", "hints"), sizes)))
    if got.graph:
        initial = kmers.patched_graph(own, got.k)[1]
        steps = {"1_init": initial, "2_trim": kmers.edge_trim(initial), "3_tip": solver.edges_of(solved, "tips"), "4_bubble": solver.edges_of(solved, "bubbles")}
        for name, weights in steps.items():
            alleles.graph_sink(alleles.graph_rows(own, got.k, weights), f"{got.graph}/{name}")
    phases = timed("phasing", lambda: stored(phasing.merged(own, stored(solver.corrected_of(solved, own).drop("island")))))
    timed("output", lambda: vcf.write_phased(table, phases, head, got.output))
    if got.timers:
        print(*(f"{k}\t{real:.2f}\t{cpu:.2f}" for k, (real, cpu) in times.items()), sep="\n", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
