"""Reference genomes and sequence files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import pieces
from .ordered import lines

#: Bases of a chunk; a chunk also holds the bases around it that windows need.
CHUNK, MARGIN = 1 << 16, 64


def index(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, offset, line_bases, line_width) of a .fai file."""
    rows = spark.read.text(path).filter(F.col("value") != "").select(F.split(F.trim("value"), r"\s+").alias("f"))
    types = (("name", "string"), ("length", "int"), ("offset", "bigint"), ("line_bases", "int"), ("line_width", "int"))
    return rows.select(*[F.get("f", F.lit(k)).cast(kind).alias(name) for k, (name, kind) in enumerate(types)])


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, seq): the whole sequence of each contig, without line ends. A name ends at the first white space."""
    entries = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head, body = F.substring_index("value", "\n", 1), F.expr("substring(value, instr(value, '\n') + 1)")
    whole = entries.select(F.regexp_extract(head, r"^\s*(\S*)", 1).alias("name"), F.regexp_replace(body, r"\s", "").alias("seq"))
    return whole.select("name", F.length("seq").alias("length"), "seq")


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, bases): every line of bases with its place (from 0) in its contig.

    Running sums go over the blocks in which files are read, and from one block to
    the next over one row for each block.
    """
    rows = lines(spark, path).select(F.struct("at.file", "at.block").alias("part"), F.col("at.line").alias("line"), F.trim("value").alias("value")).filter("value <> ''")
    is_head = F.col("value").startswith(">")
    bases = F.when(is_head, 0).otherwise(F.length("value"))
    along = W.partitionBy("part").orderBy("line")
    named = rows.select("*", F.when(is_head, F.regexp_extract("value", r"^>\s*(\S*)", 1)).alias("head"), bases.alias("n"))
    named = named.withColumn("chrom", F.last("head", True).over(along)).withColumn("heads", F.count("head").over(along))
    within = named.withColumn("before", F.sum("n").over(W.partitionBy("part", "heads").orderBy("line")) - F.col("n"))
    # One row for each block: the contig that it ends in, and how many bases it has of that.
    ends = within.groupBy("part").agg(F.max("heads").alias("heads"), F.max_by("chrom", "line").alias("last"), F.max_by(F.col("before") + F.col("n"), "line").alias("tail"))
    order = W.orderBy("part")
    ends = ends.withColumn("run", F.sum((F.col("heads") > 0).cast("int")).over(order))
    ends = ends.withColumn("so_far", F.sum("tail").over(W.partitionBy("run").orderBy("part")))
    carried = ends.select("part", F.last("last", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("open"), F.lag("so_far", 1, 0).over(order).alias("open_bases"))
    first = F.col("heads") == 0
    own = within.filter("head IS NULL").join(carried, "part")
    own = own.select(F.when(first, F.col("open")).otherwise(F.col("chrom")).alias("chrom"), (F.col("before") + F.when(first, F.col("open_bases")).otherwise(0)).alias("pos"), F.col("value").alias("bases"))
    return own.filter(F.col("chrom").isNotNull())


def chunks(spark: SparkSession, path: str, size: int = CHUNK, margin: int = MARGIN) -> DataFrame:
    """(chrom, chunk, begin, length, seq): pieces of the contigs, each with `margin` bases around; begin is the first base's place from 0.

    A line goes to the chunk or the few chunks that it touches, so that no task
    holds more than a chunk. Lines of bases are taken to be short.
    """
    rows = placed_lines(spark, path)
    end = F.col("pos") + F.length("bases")
    lowest = F.greatest(F.floor((F.col("pos") - margin) / size), F.lit(0))
    touched = rows.withColumn("chunk", F.explode(F.sequence(lowest, F.floor((end - 1 + margin) / size))))
    begin = F.greatest(F.col("chunk") * size - margin, F.lit(0))
    skipped = F.greatest(begin - F.col("pos"), F.lit(0))
    kept = F.least(end, (F.col("chunk") + 1) * size + margin) - F.col("pos") - skipped
    pieces = touched.select("chrom", F.col("chunk").cast("int").alias("chunk"), begin.cast("int").alias("begin"), (F.col("pos") + skipped).alias("pos"), F.substring("bases", (skipped + 1).cast("int"), kept.cast("int")).alias("bases")).filter("bases <> ''")
    whole = pieces.groupBy("chrom", "chunk", "begin").agg(F.array_sort(F.collect_list(F.struct("pos", "bases"))).alias("x"))
    sizes = rows.groupBy("chrom").agg(F.sum(F.length("bases")).cast("int").alias("length"))
    made = whole.join(sizes, "chrom").filter(F.col("chunk") * size < F.col("length"))
    return made.select("chrom", "chunk", "begin", "length", F.array_join(F.transform("x", lambda p: p["bases"]), "").alias("seq"))


def lookup(chroms: DataFrame, contigs: DataFrame) -> DataFrame:
    """Rows with a chrom, joined to the contig of that name (name, length, ...). One without bases, or none, is an error."""
    known = contigs.withColumnRenamed("name", "chrom")
    missing = F.raise_error(F.concat(F.lit("no reference for "), F.col("chrom"))).cast("int")
    return chroms.join(known, "chrom", "left").withColumn("length", F.when(F.coalesce("length", F.lit(0)) <= 0, missing).otherwise(F.col("length")))


class _Cut(Exception):
    """Lines end within a record."""


def _one(rows: list[bytes], k: int, final: bool) -> tuple[tuple | None, int]:
    """The record that begins behind line k or in it, and the line behind it; None if no more begin."""
    n = len(rows)
    while k < n and rows[k][:1] not in (b">", b"@"):
        k += 1
    if k == n:
        return None, n
    name, _, comment = rows[k][1:].partition(b" ") if b"\t" not in rows[k] else rows[k][1:].partition(b"\t")
    k += 1
    first = k
    while k < n and rows[k][:1] not in (b">", b"@", b"+"):
        k += 1
    if k == n and not final:
        raise _Cut
    whole, quality = b"".join([r.strip() for r in rows[first:k]]), None
    if k < n and rows[k][:1] == b"+":
        k, got, size = k + 1, [], 0
        while k < n and size < len(whole):
            got.append(rows[k].strip())
            size += len(got[-1])
            k += 1
        if size < len(whole) and not final:
            raise _Cut
        if size != len(whole):
            raise ValueError(f"record {name.decode()}: quality of {size} for {len(whole)} bases")
        quality = b"".join(got)
    return (name.decode(), comment.decode(), whole.decode(), None if quality is None else quality.decode()), k


def _parsed(rows: list[bytes], final: bool) -> tuple[list[tuple], int]:
    """(name, comment, sequence, quality) of whole records, and the number of lines that they take."""
    made, k = [], 0
    try:
        while k < len(rows):
            record, k = _one(rows, k, final)
            if record is not None:
                made.append(record)
    except _Cut:
        pass
    return made, k


def parse_records(text: str) -> Iterator[tuple[str, str, str, str | None]]:
    """(name, comment, sequence, quality) of FASTA and FASTQ records, on one or many lines each."""
    yield from _parsed(text.encode().split(b"\n"), True)[0]


#: Records that have to look like ones behind a line that is taken for a record's first, or lines of bases behind its only one.
CHAIN, BASE_LINES = 8, 100
_BASES = re.compile(rb"[A-Za-z*.=\s-]*")


def _looks_begun(rows: list[bytes], k: int) -> bool:
    """Whether a record of bases begins in line k, and such records follow, as far as lines go."""
    mark, n = rows[k][:1], len(rows)
    for seen in range(CHAIN):
        while k < n and not rows[k].strip():
            k += 1
        if k == n:
            return seen > 0
        if rows[k][:1] != mark or len(rows[k]) < 2:
            return False
        k += 1
        first, size = k, 0
        while k < n and rows[k][:1] not in (b">", b"@", b"+"):
            if not _BASES.fullmatch(rows[k]):
                return False
            size += len(rows[k].strip())
            k += 1
        if k == n:
            return seen > 0 or mark == b">" and k - first >= BASE_LINES
        if not size or (rows[k][:1] == b"+") != (mark == b"@"):
            return False
        if mark == b"@":
            k += 1
            while k < n and size > 0:
                size -= len(rows[k].strip())
                k += 1
            if size < 0:
                return False
            if size:
                return seen > 0
    return True


def _start(data: bytes) -> int | None:
    rows, at = data.split(b"\n")[:-1], 0
    for k, row in enumerate(rows):
        if row[:1] in (b">", b"@") and _looks_begun(rows, k):
            return at
        at += len(row) + 1
    return None


def _records(data: bytes, at: int, final: bool, number) -> tuple[list[pa.RecordBatch], int]:
    rows = data[at:].split(b"\n")[:-1]
    made, k = _parsed(rows, final)
    batches = []
    for a in range(0, len(made), BATCH):
        name, comment, seq, qual = zip(*made[a : a + BATCH])
        arrays = [*(pa.array(c, pa.string()) for c in (name, comment, seq, qual)), pa.array([len(s) for s in seq], pa.int32())]
        batches.append(pa.RecordBatch.from_arrays(arrays, names=["name", "comment", "seq", "qual", "len"]))
    return batches, at + sum(len(r) + 1 for r in rows[:k])


def _skip(data: bytes, at: int) -> int:
    rows = data[at:].split(b"\n")[:-1]
    return at + sum(len(r) + 1 for r in rows[: _parsed(rows, False)[1]])


#: Records that go to Spark, and lines that come from it, at once.
BATCH = 4096
_FORMAT = pieces.Format(lambda rows: b"\n".join(rows) + b"\n", _start, _records, _skip, rows=BATCH)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(name, comment, seq, qual, len) of sequence files, in a task for each split; a record may lie in several.

    In a split, records begin where eight of them in a row, or as many as it has, look
    like FASTA or FASTQ with bases of letters; what lies between two such places is
    parsed as one. Lines before a file's first record are left out. A quality of
    another length than its bases is an error.
    """
    file = F.col("_metadata.file_path")
    return pieces.records(pieces.read(spark, path, file, F.lit(True)), _FORMAT, "name string, comment string, seq string, qual string, len int")
