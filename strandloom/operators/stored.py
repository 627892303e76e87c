"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession) -> str:
    """A path of its own in the folder that spark.checkpoint.dir names.

    Only where that is unset and all runs on one machine, a temporary folder is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        else:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandloom-"))
            root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written once and read again: later steps start from the table, also after a lost executor."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df, with the hint that a join sorts it by its key and doesn't broadcast it.

    For what grows with the input. Spark goes by the size of files or of what an explode was made from, and either may be a
    few MB where the rows, as the driver collects them for a broadcast, take GB.
    """
    return df.hint("merge")
