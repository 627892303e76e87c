"""CIGAR strings as arrays of (op, len), and where they put a reference position in the read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CIGAR_TYPE = "array<struct<op:string,len:int>>"


def parse_cigar(text: Column) -> Column:
    """The operations of a CIGAR text; '*' and null have none."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    return F.transform(pieces, lambda p: F.struct(F.substring(p, -1, 1).alias("op"), F.regexp_extract(p, "[0-9]+", 0).cast("int").alias("len")))


def _takes_query(op: Column, strict: bool) -> Column:
    return op.isin("M", "I", "S", "=", "X") if strict else ~op.isin("D", "H")


def _takes_reference(op: Column, strict: bool) -> Column:
    return op.isin("M", "D", "N", "=", "X") if strict else ~op.isin("I", "S", "H")


def _total(cigar: Column, takes) -> Column:
    return F.aggregate(cigar, F.lit(0), lambda n, c: n + F.when(takes(c["op"]), c["len"]).otherwise(0))


def cigar_spans(cigar: Column, strict: bool = False) -> Column:
    """(read_len, ref_len). Skips and padding count for both lengths unless `strict` takes the format's own table."""
    return F.struct(_total(cigar, lambda op: _takes_query(op, strict)).alias("read_len"), _total(cigar, lambda op: _takes_reference(op, strict)).alias("ref_len"))


def query_pos(cigar: Column, start: Column, pos: Column, strict: bool = False) -> Column:
    """The place (from 0) in the read of a reference position; on a deletion the place before it. start: where the read begins."""
    zero = F.struct(F.lit(0).cast("long").alias("q"), start.cast("long").alias("r"), F.lit(None).cast("long").alias("found"))

    def step(a: Column, c: Column) -> Column:
        takes_q, takes_r = _takes_query(c["op"], strict), _takes_reference(c["op"], strict)
        here = a["found"].isNull() & takes_r & (a["r"] + c["len"] > pos)
        place = F.when(takes_q, a["q"] + pos - a["r"]).otherwise(a["q"] - 1)
        return F.struct(
            (a["q"] + F.when(takes_q, c["len"]).otherwise(0)).cast("long").alias("q"),
            (a["r"] + F.when(takes_r, c["len"]).otherwise(0)).cast("long").alias("r"),
            F.when(here, place).otherwise(a["found"]).cast("long").alias("found"),
        )

    return F.aggregate(cigar, zero, step)["found"]


def base_code(sequence: Column) -> Column:
    """Upper case; all but A, C, G and T become N."""
    return F.regexp_replace(F.upper(sequence), "[^ACGT]", "N")


def allele_call(to_ref: Column, to_alt: Column) -> Column:
    """0 if the reference is nearer, 1 if the alternative is, -1 at a tie."""
    return F.when(to_ref < to_alt, 0).when(to_ref > to_alt, 1).otherwise(-1)
