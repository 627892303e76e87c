"""From allele calls to phased variants."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandloom.operators import blocks, reads, solver
from strandloom.operators.stored import stored

DEFAULT_K, ALLOWED_K = 2, (2, 3, 4, 5)


def phase(alleles: DataFrame, k: int = DEFAULT_K, sizes: DataFrame | None = None) -> DataFrame:
    """(chrom, snp_idx, ps_idx, phase) of every variant that some block phases; ps_idx is its phase set's first variant.

    alleles: (chrom, rid, snp_idx, allele), allele -1 for a gap. A read's order
    and number do not matter, only which calls belong together. sizes: (chrom,
    n_snp), where variants follow the last one that a read reaches. Without any
    read of two calls the result is empty.
    """
    if k not in ALLOWED_K:
        k = DEFAULT_K
    own = stored(reads.informative_reads(alleles))
    return merged(own, stored(solver.solve(own, k, "corrected", sizes).drop("island")))


def merged(own: DataFrame, corrected: DataFrame) -> DataFrame:
    """The last step of `phase`: blocks that reads connect become one phase set."""
    return blocks.merged_phases(corrected, blocks.block_connect(own, corrected))
