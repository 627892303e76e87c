"""Variant files: reading, headers, and writing phases back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions.text import join_str, split_str, swapped

from .ordered import lines, numbered

#: The header lines of the two keys that phasing needs.
FORMATS = {
    "GT": '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    "PS": '##FORMAT=<ID=PS,Number=1,Type=Integer,Description="Phase set identifier">',
}


def header(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, key, value, raw) of the lines that begin with #; key is null on the line of column names."""
    found = lines(spark, path).filter(F.col("value").startswith("#"))
    rows = numbered(found, "line_no").select(F.col("line_no").cast("int").alias("line_no"), F.col("value").alias("raw"))
    pattern = "^##([^=]*)=(.*)$"
    part = lambda k: F.when(F.col("raw").rlike(pattern), F.regexp_extract("raw", pattern, k))
    return rows.select("line_no", part(1).alias("key"), part(2).alias("value"), "raw")


def samples(head: DataFrame) -> int:
    """The number of samples that the line of column names has; phasing needs one."""
    row = head.filter(F.col("raw").startswith("#CHROM")).select(F.size(split_str(F.col("raw"), "\t")).alias("n")).first()
    return max(0, row.n - 9) if row else 0


def annotate_header(head: DataFrame) -> DataFrame:
    """The header with lines for GT and PS, where they are missing, before the column names."""
    spark = head.sparkSession
    have = {r.name for r in head.filter("key = 'FORMAT'").select(F.regexp_extract("value", "^<ID=([^,>]*)", 1).alias("name")).collect()}
    more = [(key, raw) for key, raw in FORMATS.items() if key not in have]
    if not more:
        return head
    last = head.agg(F.max("line_no")).first()[0] or 0
    added = spark.createDataFrame([(last + k, "FORMAT", raw.split("=", 1)[1], raw) for k, (_, raw) in enumerate(more)], "line_no int, key string, value string, raw string")
    moved = head.withColumn("line_no", F.when(F.col("raw").startswith("#CHROM"), F.col("line_no") + len(more)).otherwise(F.col("line_no")))
    return moved.unionByName(added)


def snp_index(rows: DataFrame, *ties: str) -> DataFrame:
    """rows with `snp_idx`, their number within the chromosome by position, and by the columns `ties` at equal positions."""
    return rows.withColumn("snp_idx", (F.row_number().over(W.partitionBy("chrom").orderBy("pos", *ties)) - 1).cast("long"))


def variants(spark: SparkSession, path: str, chrom: str | None = None) -> DataFrame:
    """(chrom, chrom_ord, snp_idx, pos, ref, alt, fields) of the single-base variants.

    Empty fields are left out of a line. Chromosomes are numbered as they first
    appear; variants of one are sorted by position, equal ones as in the file.
    """
    rows = lines(spark, path).filter(~F.col("value").startswith("#") & (F.col("value") != "")).select("at", split_str(F.col("value"), "\t").alias("fields"))
    at = lambda k: F.get("fields", F.lit(k))
    rows = rows.select("at", at(0).alias("chrom"), at(1).cast("int").alias("pos"), at(3).alias("ref"), at(4).alias("alt"), "fields")
    rows = rows.filter((F.length("ref") == 1) & (F.length("alt") == 1))
    if chrom is not None:
        rows = rows.filter(F.col("chrom") == chrom)
    order = rows.groupBy("chrom").agg(F.min("at").alias("first")).select("chrom", (F.row_number().over(W.orderBy("first")) - 1).alias("chrom_ord"))  # one row for each chromosome
    return snp_index(rows, "at").join(F.broadcast(order), "chrom").select("chrom", "chrom_ord", "snp_idx", "pos", "ref", "alt", "fields")


def _rewritten(fields, gt, ps):
    """A line's fields with phase: GT first, GQ second, PS third, as far as there are so many, and the phase's values set."""
    keys, values = split_str(F.get(fields, F.lit(8)), ":"), split_str(F.get(fields, F.lit(9)), ":")
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    for key in ("GT", "PS"):
        missing = F.struct(F.lit(key).alias("k"), F.lit(".").alias("v"))
        pairs = F.when(F.array_contains(F.transform(pairs, lambda p: p["k"]), key), pairs).otherwise(F.concat(pairs, F.array(missing)))

    def step(now, i):
        for place, key in enumerate(("GT", "GQ", "PS")):
            now = F.when(F.get(now, i)["k"] == key, swapped(now, i, F.lit(place))).otherwise(now)
        return now

    moved = F.aggregate(F.sequence(F.lit(0), F.size(pairs) - 1), pairs, step)
    genotype = F.when(gt == 0, "0|1").when(gt == 1, "1|0")
    value = lambda p: F.when(gt.isNull(), p["v"]).when(p["k"] == "GT", genotype).when(p["k"] == "PS", ps.cast("string")).otherwise(p["v"])
    done = F.struct(join_str(F.transform(moved, lambda p: p["k"]), ":").alias("format"), join_str(F.transform(moved, value), ":").alias("sample"))
    return done


def phased_lines(table: DataFrame, phases: DataFrame) -> DataFrame:
    """(chrom_ord, snp_idx, value): every variant's line, with phase where `phases` (chrom, snp_idx, ps_idx, phase) has one.

    The phase set's name is the position of its first variant. Lines without a
    format and a sample stay as they are.
    """
    first = table.select("chrom", F.col("snp_idx").alias("ps_idx"), F.col("pos").alias("ps"))
    own = phases.join(first, ["chrom", "ps_idx"]).select("chrom", "snp_idx", "ps", "phase")
    rows = table.join(own, ["chrom", "snp_idx"], "left").withColumn("new", _rewritten(F.col("fields"), F.col("phase"), F.col("ps")))
    line = F.concat(F.slice("fields", 1, 8), F.array("new.format", "new.sample"))
    return rows.select("chrom_ord", "snp_idx", join_str(F.when(F.size("fields") > 9, line).otherwise(F.col("fields")), "\t").alias("value"))


def write_phased(table: DataFrame, phases: DataFrame, head: DataFrame, path: str) -> None:
    """The header and all variants in order, as a folder of text parts that follow each other by name."""
    top = annotate_header(head).select(F.lit(-1).alias("chrom_ord"), F.col("line_no").cast("long").alias("snp_idx"), F.col("raw").alias("value"))
    top.unionByName(phased_lines(table, phases)).orderBy("chrom_ord", "snp_idx").select("value").write.mode("overwrite").text(path)


def phased_variants(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ps, gt) of the lines whose genotype is 0|1 (gt 0) or 1|0 (gt 1) and that have a phase set."""
    fields = lines(spark, path).filter(~F.col("value").startswith("#")).select(split_str(F.col("value"), "\t").alias("f"))
    pairs = F.map_from_arrays(split_str(F.get("f", F.lit(8)), ":"), split_str(F.get("f", F.lit(9)), ":"))
    rows = fields.filter(F.size("f") > 9).select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).cast("int").alias("pos"), pairs.alias("m"))
    kept = rows.filter(F.try_element_at("m", F.lit("GT")).isin("0|1", "1|0") & (F.coalesce(F.try_element_at("m", F.lit("PS")), F.lit(".")) != "."))
    return kept.select("chrom", "pos", F.element_at("m", "PS").cast("int").alias("ps"), (F.element_at("m", "GT") == "1|0").cast("int").alias("gt"))
