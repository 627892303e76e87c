"""Records of files that Spark reads in parts, where a record may run from one part into the next ones.

A part is what one split of a file holds. Its task looks for a place where a
record begins, takes the whole records from there on, and leaves the bytes before
and behind them. These are put together with those of the parts around: what lies
between the first place of one part and that of the next has to be whole records,
to the last byte, or it is an error. The first place of a file is known, so that by
this each further one is held to be right as well, and no record is lost.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes in which a part's first record is looked for at once, and those that are parsed at once.
LOOK, STEP = 1 << 20, 4 << 20
PART = "part struct<stream:string,file:string,block:bigint>"


@dataclass(frozen=True)
class Format:
    """What a kind of file says of its records; each function gets bytes and a place in them.

    unpack: the bytes that pieces in a row stand for, `rows` of them at most. start: the first place where a record
    begins, or None if none is seen. parse: the whole records from a place on, as
    Arrow batches, and the place behind them; with `final` no more bytes come; the
    last argument gives a number of its own to each place. skip: the place behind
    them alone. origin: where the first record of a stream begins.
    """

    unpack: Callable[[list[bytes]], bytes]
    start: Callable[[bytes], int | None]
    parse: Callable[[bytes, int, bool, Callable[[int], int]], tuple[list[pa.RecordBatch], int]]
    skip: Callable[[bytes, int], int]
    origin: int = 0
    rows: int = 16


class _Part:
    """One part: bytes before its first record, then whole records, and what is left behind them."""

    def __init__(self, form: Format, first: bool, number: int):
        self.form, self.first, self.number, self.begin = form, first, number, number
        self.held, self.size, self.head, self.next = [], 0, None, LOOK

    def add(self, data: bytes) -> None:
        self.held.append(data)
        self.size += len(data)

    def _find(self, ended: bool) -> None:
        """Looks for the first record, each time in twice as many bytes."""
        if self.head is None and (ended or self.size >= self.next):
            data = b"".join(self.held)
            at = (self.form.origin if len(data) >= self.form.origin else None) if self.first else self.form.start(data)
            self.held, self.next = [data], 2 * len(data)
            if at is not None:
                self.head, self.held, self.size, self.number = data[:at], [data[at:]], len(data) - at, self.number + at

    def whole(self, ended: bool, rows: bool) -> list[pa.RecordBatch]:
        """The whole records so far; without `rows` they are passed over."""
        self._find(ended)
        if self.head is None or not (ended or self.size >= STEP):
            return []
        data = b"".join(self.held)
        made, at = self.form.parse(data, 0, False, self.number.__add__) if rows else ([], self.form.skip(data, 0))
        self.held, self.size, self.number = [data[at:]], len(data) - at, self.number + at
        return made

    def left(self) -> list[tuple[int, bytes, int]]:
        """(0, bytes before the first record), (1, bytes behind the last whole one), each with its number; all are of the first kind where no record begins."""
        rest = b"".join(self.held)
        return [(0, rest, self.begin)] if self.head is None else [(0, self.head, self.begin), (1, rest, self.number)]


def _stretches(batch: pa.RecordBatch, most: int) -> Iterator[tuple[dict, bool, int, list[bytes]]]:
    """(part, first, number, values) of rows in a row that are of one part, so many at most."""
    part, first, number, value = (batch.column(c) for c in ("part", "first", "number", "value"))
    new = np.zeros(max(len(part) - 1, 0), bool)
    for own in part.flatten():
        new |= pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)
    ends = [0, *(np.flatnonzero(new) + 1).tolist(), len(part)]
    for begin, end in zip(ends, ends[1:]):
        for a in range(begin, end, most):
            yield part[a].as_py(), first[a].as_py(), number[a].as_py(), value[a : min(a + most, end)].to_pylist()


def _walk(batches: Iterator[pa.RecordBatch], form: Format, rows: bool) -> Iterator[tuple[dict, _Part, list[pa.RecordBatch], bool]]:
    """Feeds the pieces, which come in the order of their files, to their parts."""
    key, part, place = None, None, 0
    for batch in batches:
        for own, first, number, values in _stretches(batch, form.rows):
            if own != key:
                if part is not None:
                    yield key, part, part.whole(True, rows), True
                key, part = own, _Part(form, first, number + place)
            data = form.unpack(values)
            part.add(data)
            place += len(data)
            yield key, part, part.whole(False, rows), False
    if part is not None:
        yield key, part, part.whole(True, rows), True


def read(spark: SparkSession, path: str, stream: Column, first: Column, **options) -> DataFrame:
    """(part, first, number, value): the pieces of files between separators, in the order of their parts; `stream` and `first` by the file's path and block."""
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    part = F.struct(stream.alias("stream"), file.alias("file"), block.alias("block"))
    # A number for each byte of what one task reads.
    number = F.spark_partition_id().cast("long") * (1 << 40)
    return spark.read.options(**options).text(path).select(part.alias("part"), (first & (block == 0)).alias("first"), number.alias("number"), F.col("value").cast("binary").alias("value"))


def records(pieces: DataFrame, form: Format, schema: str) -> DataFrame:
    """The records of `pieces`, as `read` gives them.

    A part's stream holds the files that follow each other as one; `first` is true in
    the first part of a stream. The files are read twice, for the records that lie in
    one part and for the rest. The bytes left of the parts of one stream, about a
    record for each part, are ordered in one task.
    """

    def inside(batches):
        for _, _, made, _ in _walk(batches, form, True):
            yield from made

    def fragments(batches):
        for key, part, _, ended in _walk(batches, form, False):
            if ended:
                side, data, number = zip(*part.left())
                arrays = [pa.array([key] * len(side), pa.struct([("stream", pa.string()), ("file", pa.string()), ("block", pa.int64())])), pa.array(side, pa.int32()), pa.array(data, pa.binary()), pa.array(number, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "side", "data", "number"])

    def across(batches):
        for batch in batches:
            for run, held in zip(batch.column("run").to_pylist(), batch.column("held")):
                parts = held.as_py()
                ends = list(itertools.accumulate((len(p["data"]) for p in parts), initial=0))

                def number(place):
                    k = bisect.bisect_right(ends, place) - 1
                    return parts[k]["number"] + place - ends[k]

                data, at = b"".join([p["data"] for p in parts]), form.origin if run == 0 else 0
                made, end = form.parse(data, at, True, number) if len(data) >= at else ([], -1)
                if end != len(data):
                    where = parts[0]["part"]
                    raise ValueError(f"no whole records from block {where['block']} of {where['file']} on: the file is cut off, or a record isn't one")
                yield from made

    rest = pieces.mapInArrow(fragments, f"{PART}, side int, data binary, number bigint")
    stream = F.col("part.stream")
    rest = rest.withColumn("run", F.sum("side").over(W.partitionBy(stream).orderBy("part", "side").rowsBetween(W.unboundedPreceding, 0)))
    runs = rest.groupBy(stream.alias("stream"), "run").agg(F.array_sort(F.collect_list(F.struct("part", "side", "data", "number"))).alias("held"))
    return pieces.mapInArrow(inside, schema).union(runs.select("run", "held").mapInArrow(across, schema))
