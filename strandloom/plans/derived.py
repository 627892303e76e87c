"""A deterministic read-by-variant allele matrix over the order tables.

A read is an order, its chromosome the order key modulo 3, and the order's
lines are calls of consecutive variants. See `matrix_sql` for the arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Calls that a task orders. Tasks grow in number with the calls, so that what one of them holds doesn't.
CALLS = 1 << 19


def alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, rid, snp_idx, allele); allele is 0, 1, or -1 for a gap."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # The number of rows is in the files' footers. Orders stay together in all that works on reads, until words are counted.
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // CALLS))
    # A subquery of one number: that doesn't run while the plan is made.
    variants = F.greatest(lines.select(F.expr("count(DISTINCT l_orderkey) * 2 div 15")).scalar(), F.lit(50))
    order = W.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    rows = lines.repartition(tasks, "l_orderkey").select(
        F.col("l_orderkey").alias("rid"),
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
        (F.row_number().over(order) - 1).cast("long").alias("j"),
    ).select("rid", "pk", "sk", ((F.col("rid") * 7919) % variants + F.col("j")).alias("snp_idx"))
    true = F.expr("((snp_idx * 2654435761) div 65536) % 2 + (rid div 3) % 2") + F.when(F.col("pk") % 17 == 0, 1).otherwise(0)
    return rows.select(
        F.concat(F.lit("c"), (F.col("rid") % 3).cast("string")).alias("chrom"),
        "rid",
        "snp_idx",
        F.when(F.col("sk") % 23 == 0, -1).otherwise(true % 2).cast("int").alias("allele"),
    )


#: The same matrix in SQL for DuckDB, as the first of a chain of common table expressions.
MATRIX_SQL = """
n AS (SELECT greatest(count(DISTINCT l_orderkey) * 2 // 15, 50) AS nn FROM lineitem),
r AS (SELECT l_orderkey AS rid, l_partkey AS pk, l_suppkey AS sk,
        row_number() OVER (PARTITION BY l_orderkey
          ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) AS j FROM lineitem),
s AS (SELECT rid, 'c' || (rid % 3) AS chrom, ((rid * 7919) % nn + j - 1)::BIGINT AS snp_idx, pk, sk FROM r, n),
m AS (SELECT chrom, rid, snp_idx,
        (CASE WHEN sk % 23 = 0 THEN -1
              ELSE (((snp_idx * 2654435761) // 65536) % 2 + (rid // 3) % 2
                    + (CASE WHEN pk % 17 = 0 THEN 1 ELSE 0 END)) % 2 END)::INTEGER AS allele FROM s)"""


def true_phase(snp: F.col) -> F.col:
    return F.expr(f"((({snp} * 2654435761) div 65536) % 2)")
