"""Read-based haplotype assembly expressed as Spark DataFrame plans."""
