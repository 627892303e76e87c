"""Helpers shared by the text operators."""

from __future__ import annotations

import glob
import mmap
import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Texts are handed to the per-batch functions in slices of about this many bytes.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    ``spark.checkpoint.dir`` names that folder on a cluster; only where it is
    unset and all runs on one machine (tests), a temporary folder is set in its place.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = context._jsc.sc().getCheckpointDir().getOrElse(None) if context._jsc.sc().getCheckpointDir().isDefined() else None
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="strandloom-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the table that `written` made, when nothing reads it any more."""
    context = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = context._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def mounted_dir(spark: SparkSession) -> str | None:
    """A new folder in the shared one that Python workers can open as files; None where that is a store that only Spark reads."""
    path = shared_dir(spark)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    if uri.getScheme() != "file":
        return None
    os.makedirs(uri.getPath(), exist_ok=True)
    return uri.getPath()


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as bytes that `unpack` reads in place."""
    head, at, parts = {}, 0, []
    for name, a in arrays.items():
        data = np.ascontiguousarray(a).tobytes()
        head[name] = (a.dtype.str, len(a), at)
        parts += [data, bytes(-len(data) % 8)]
        at += len(data) + -len(data) % 8
    said = pickle.dumps(head)
    return b"".join([len(said).to_bytes(8, "little"), said, bytes(-len(said) % 8), *parts])


def unpack(data) -> dict[str, np.ndarray]:
    """The arrays of `pack`, from bytes or a memory map, without a copy."""
    size = int.from_bytes(data[:8], "little")
    base = 8 + size + -size % 8
    return {name: np.frombuffer(data, kind, n, base + at) for name, (kind, n, at) in pickle.loads(data[8 : 8 + size]).items()}


def put_file(folder: str, name: str, data: bytes) -> None:
    """A whole file or none; a task that runs again puts the same one."""
    made = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(made, "wb") as f:
        f.write(data)
    os.replace(made, f"{folder}/{name}")


def mapped(path: str) -> mmap.mmap:
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


class Pieces:
    """Numbered pieces of an index as files on a worker: those of a mounted folder, or fetched by Spark from the folder that only it reads.

    numbers: the pieces that there are. One of them whose file is missing is an error, never an empty piece.
    """

    def __init__(self, numbers: list[int], folder: str | None, fetched: str | None = None):
        self.numbers, self.folder, self.fetched = frozenset(numbers), folder, fetched

    def open(self, number: int) -> mmap.mmap | None:
        """The piece's bytes, mapped; None if there is no such piece."""
        if number not in self.numbers:
            return None
        path = f"{self.folder}/{number}" if self.folder else self._unpacked(number)
        try:
            return mapped(path)
        except FileNotFoundError as missing:
            raise FileNotFoundError(f"piece {number} of an index is missing: {path}; do all executors see the folder of spark.checkpoint.dir?") from missing

    def _unpacked(self, number: int) -> str:
        """The piece as a file of its own beside what Spark has fetched, so that all workers of an executor map the same one."""
        folder = SparkFiles.get(self.fetched)
        if not os.path.exists(f"{folder}/{number}"):
            (own,) = [f for f in glob.glob(f"{glob.escape(folder)}/piece={number}/*.parquet") if pq.read_metadata(f).num_rows] or [f"{folder}/piece={number}"]
            put_file(folder, str(number), pq.read_table(own, columns=["data"]).column(0)[0].as_py())
        return f"{folder}/{number}"


def pieces(spark: SparkSession, build: Callable[[str | None], DataFrame]) -> Pieces:
    """An index in pieces where every worker can read it.

    build makes (piece, data), one row a piece; with a folder it puts the data there as files, by `put_file`,
    and gives the numbers only. Where the shared folder is a store that only Spark reads, the rows are written there, and
    Spark brings the files to each executor once, before its next task, also to those that come later.
    """
    if folder := mounted_dir(spark):
        return Pieces([r[0] for r in build(folder).select("piece").collect()], folder)
    path = shared_dir(spark)
    build(None).write.option("compression", "none").partitionBy("piece").parquet(path)
    spark.sparkContext.addFile(path, recursive=True)
    return Pieces([r[0] for r in spark.read.parquet(path).select("piece").distinct().collect()], None, path.rsplit("/", 1)[1])


def whole_numbers(df: DataFrame, id_col: str) -> None:
    """Raise TypeError unless the ids are integers (of at most 64 bits), which operators that order documents need."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{id_col} is of type {kind.simpleString()}; ids have to be integers")


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose `column` holds about SLICE_BYTES."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes, dtype=np.int64) - sizes) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def map_texts(df: DataFrame, columns: list[str], schema: T.StructType, function: Callable[[pa.RecordBatch], dict], text: str, carry: bool = False) -> DataFrame:
    """Apply `function` to slices of `columns`; it returns one array for each field of `schema`.

    With `carry` the input's other columns stay in front of the new ones; one of
    the same name (in any case) gives way to the new one. Without it only the
    first of `columns` stays, so that names of extra columns never matter.
    """
    new = {f.name.lower() for f in schema}
    kept = [f for f in df.schema if (carry or f.name == columns[0]) and f.name.lower() not in new]
    needed = list(dict.fromkeys([f.name for f in kept] + columns))
    out = T.StructType([*kept, *schema.fields])
    types = {f.name: to_arrow_type(f.dataType) for f in schema}
    stay = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                made = function(batch)
                arrays = [batch.column(n) for n in stay] + [made[n] if isinstance(made[n], pa.Array) else pa.array(made[n], types[n]) for n in types]
                yield pa.RecordBatch.from_arrays(arrays, names=[*stay, *types])

    return df.select(*[f"`{n}`" for n in needed]).mapInArrow(run, out)
