"""Text lines with a column that keeps their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, at): `at` orders lines by file, block of the file, and place in the block. Compressed files are read as they are."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", at.alias("at"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows of `lines` with their number from 0 as a column: places in a block of a file, and a sum over one row for each block."""
    rows = rows.withColumn("_part", F.struct("at.file", "at.block"))
    within = rows.withColumn("_within", F.row_number().over(W.partitionBy("_part").orderBy("at.line")) - 1)
    counts = rows.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.select("_part", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("_before"))
    return within.join(before, "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")
