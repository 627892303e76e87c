"""Numeric helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def roundup_pow2(x: Column) -> Column:
    """The least power of two that is at least x (1 for x up to 1)."""
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin((x - 1).cast("long")))).cast("long"))


def logsumexp10(a: Column, b: Column) -> Column:
    """log10(10**a + 10**b), also where both powers are out of range."""
    return F.greatest(a, b) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(a - b)))


def phred_to_prob(quality: Column) -> Column:
    """The probability of an error at a Phred quality."""
    return F.pow(F.lit(10.0), -quality / 10)


def cut_edge_weight(error_u: Column, error_v: Column, equal_alleles: Column, equal_phases: Column) -> Column:
    """log10 odds that a fragment supports the present phases of two variants, from its error probabilities there."""
    both = (1 - error_u) * (1 - error_v) + error_u * error_v
    one = (1 - error_u) * error_v + error_u * (1 - error_v)
    return F.when(equal_alleles == equal_phases, F.log10(both / one)).otherwise(F.log10(one / both))
