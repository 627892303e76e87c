"""Aligned reads from SAM text and BAM files: (chrom, rid, qname, flag, mapq, pos0, cigar, seq)."""

from __future__ import annotations

import gzip
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandloom.functions.cigar import parse_cigar
from strandloom.functions.text import split_str

from . import pieces

SCHEMA = "chrom string, rid bigint, qname string, flag int, mapq int, pos0 bigint, cigar array<struct<op:string,len:int>>, seq string"
#: Letters of operations and bases by their codes.
OPERATIONS, BASES = "MIDNSHP=XB", "=ACMGRSVTWYHKDBN"
#: Bases by hexadecimal digits, and back.
FROM_HEX, TO_HEX = str.maketrans("0123456789abcdef", BASES), str.maketrans(BASES, "0123456789abcdef")
#: How a block begins whose size (two bytes) comes next, and the block at a file's end.
BLOCK, END = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0", b"\x1b\0\x03" + bytes(9)
#: Records that have to look like ones behind a place that is taken for a record's; bytes of a block that is written.
CHAIN, BLOCK_BYTES = 8, 60_000
#: Bytes of the file in one partition, about, and alignments that go to Spark at once.
SPLIT, BATCH = 32 << 20, 4096


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text. Header lines, unmapped reads and reads without bases are left out."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.col("value") != "")).select(split_str(F.col("value"), "\t").alias("f"))
    at = lambda k: F.get("f", F.lit(k))
    whole = rows.select(at(2).alias("chrom"), F.monotonically_increasing_id().alias("rid"), at(0).alias("qname"), at(1).cast("int").alias("flag"), at(4).cast("int").alias("mapq"), (at(3).cast("bigint") - 1).alias("pos0"), parse_cigar(at(5)).alias("cigar"), at(9).alias("seq"))
    return whole.filter("chrom <> '*' AND pos0 >= 0 AND seq <> '*'")


class _Piece(InputPartition):
    """Alignments from one virtual offset up to another, of one contig; without an index the whole file."""

    def __init__(self, names: dict[int, str], number: int | None = None, start: int = 0, stop: int | None = None):
        self.names, self.number, self.start, self.stop = names, number, start, stop


class _Blocks:
    """The bytes of a file of gzip blocks from a virtual offset on: place of the block in the file << 16 | place in its bytes."""

    def __init__(self, raw, start: int):
        self.raw, self.next, self.data, self.at = raw, start >> 16, b"", 0
        raw.seek(self.next)
        if start & 0xFFFF:
            self._load()
            self.at = start & 0xFFFF

    def _load(self) -> bool:
        head = self.raw.read(12)
        if len(head) < 12:
            return False
        (extra,) = struct.unpack_from("<H", head, 10)
        fields, at, size = self.raw.read(extra), 0, None
        while at + 4 <= extra:
            kind, n = fields[at : at + 2], struct.unpack_from("<H", fields, at + 2)[0]
            if kind == b"BC":
                size = struct.unpack_from("<H", fields, at + 4)[0] + 1
            at += 4 + n
        if size is None:
            raise ValueError("an index needs a file of gzip blocks that say their size")
        body = self.raw.read(size - 12 - extra)
        self.place, self.next = self.next, self.next + size
        self.data, self.at = zlib.decompress(body[:-8], -15), 0
        return True

    def tell(self) -> int:
        return self.next << 16 if self.at >= len(self.data) else self.place << 16 | self.at

    def read(self, n: int) -> bytes:
        parts = []
        while n:
            if self.at >= len(self.data):
                if not self._load():
                    break
                continue
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)


class BamReader(DataSourceReader):
    """With an index a partition for every `split` bytes of a contig's blocks; without one the file is read once, in one."""

    def __init__(self, path: str, split: int, only: str | None):
        self.path, self.split, self.only = path, split, only

    def partitions(self):
        with gzip.open(self.path) as data:
            names = _contigs(data)[0]
        wanted = {k: name for k, name in enumerate(names) if self.only in (None, name)}
        offsets = _index(self.path, len(names))
        if offsets is None:
            return [_Piece(wanted)]
        made = []
        for number, own in sorted(offsets.items()):
            if number not in wanted:
                continue
            cuts = own[:1]
            for o in own[1:]:
                if (o >> 16) - (cuts[-1] >> 16) >= self.split:
                    cuts.append(o)
            made += [_Piece({number: wanted[number]}, number, a, b) for a, b in zip(cuts, [*cuts[1:], None])]
        return made

    def _records(self, partition: _Piece) -> Iterator[tuple[int, bytes]]:
        """(a number of its own, bytes) of each record."""
        with open(self.path, "rb") as raw:
            if partition.number is None:
                data, count = gzip.GzipFile(fileobj=raw), 0
                _contigs(data)
                while len(head := data.read(4)) == 4:
                    yield count, data.read(struct.unpack("<i", head)[0])
                    count += 1
                return
            data = _Blocks(raw, partition.start)
            while partition.stop is None or data.tell() < partition.stop:
                at = data.tell()
                if len(head := data.read(4)) < 4:
                    return
                yield at, data.read(struct.unpack("<i", head)[0])

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for rid, body in self._records(partition):
            if partition.number is not None and struct.unpack_from("<i", body)[0] != partition.number:
                break  # files with an index are sorted
            if (row := _row(partition.names, rid, body)) is None:
                continue
            rows.append(row)
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _row(names: dict[int, str], rid: int, body: bytes) -> tuple | None:
    """A record's alignment; None if it has none, no bases, or is of a contig that isn't asked for."""
    number, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", body)
    if pos < 0 or not l_seq or number not in names:
        return None
    at = 32 + l_name
    name, packed = body[32 : at - 1].split(b"\0")[0].decode(), struct.unpack_from(f"<{n_cigar}I", body, at)
    at += 4 * n_cigar
    seq = body[at : at + (l_seq + 1) // 2].hex().translate(FROM_HEX)[:l_seq]
    return names[number], rid, name, flag, mapq, pos, [{"op": OPERATIONS[c & 15], "len": c >> 4} for c in packed], seq


ARROW = pa.schema([("chrom", pa.string()), ("rid", pa.int64()), ("qname", pa.string()), ("flag", pa.int32()), ("mapq", pa.int32()), ("pos0", pa.int64()), ("cigar", pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))), ("seq", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class BamSource(DataSource):
    """spark.read.format("bam").load(path)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("a path is needed")
        return BamReader(path, int(self.options.get("split", SPLIT)), self.options.get("chrom"))


def _contigs(data) -> tuple[list[str], list[int]]:
    """The contigs' names and lengths; the reader then stands before the first alignment."""
    if data.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    data.read(struct.unpack("<i", data.read(4))[0])
    names, lengths = [], []
    for _ in range(struct.unpack("<i", data.read(4))[0]):
        size = struct.unpack("<i", data.read(4))[0]
        names.append(data.read(size)[:-1].decode())
        lengths.append(struct.unpack("<i", data.read(4))[0])
    return names, lengths


def _index(path: str, contigs: int) -> dict[int, list[int]] | None:
    """For each contig where alignments begin, ascending, from the .bai or .csi file beside the BAM. None without one."""
    if os.path.exists(path + ".bai"):
        with open(path + ".bai", "rb") as f:
            return _bai(f.read(), contigs)
    if os.path.exists(path + ".csi"):
        with gzip.open(path + ".csi") as f:
            return _csi(f.read())
    return None


def _bai(data: bytes, contigs: int) -> dict[int, list[int]]:
    """A contig's first alignment, and the first over each window."""
    at, out = 8, {}
    for number in range(contigs):
        (bins,) = struct.unpack_from("<i", data, at)
        at += 4
        begins = []
        for _ in range(bins):
            name, pieces = struct.unpack_from("<Ii", data, at)
            at += 8
            if name != 37450:  # the bin of counts
                begins += [struct.unpack_from("<QQ", data, at + 16 * k)[0] for k in range(pieces)]
            at += 16 * pieces
        (windows,) = struct.unpack_from("<i", data, at)
        over = struct.unpack_from(f"<{windows}Q", data, at + 4)
        at += 4 + 8 * windows
        if begins:
            out[number] = sorted({min(begins), *(o for o in over if o > min(begins))})
    return out


def _csi(data: bytes) -> dict[int, list[int]]:
    """The first alignment of each run that a bin names; the bins' sizes are the file's own."""
    if data[:4] != b"CSI\1":
        raise ValueError("not an index of this kind")
    _, depth, extra = struct.unpack_from("<iii", data, 4)
    counts, at, out = ((1 << 3 * (depth + 1)) - 1) // 7 + 1, 16 + extra, {}
    (contigs,) = struct.unpack_from("<i", data, at)
    at += 4
    for number in range(contigs):
        (bins,) = struct.unpack_from("<i", data, at)
        at += 4
        begins = set()
        for _ in range(bins):
            name, _, runs = struct.unpack_from("<IQi", data, at)
            at += 16
            if name != counts:
                begins.update(struct.unpack_from("<Q", data, at + 16 * k)[0] for k in range(runs))
            at += 16 * runs
        if begins:
            out[number] = sorted(begins)
    return out


# Files without an index: Spark's text reader cuts them where blocks begin, on any file system.


def _unpacked(piece: bytes) -> bytes:
    """The bytes of the blocks of a piece: what follows a block's fixed beginning, up to the next one."""
    if not piece:
        return b""
    data, size = BLOCK + piece, None
    if len(piece) >= 2:
        size = struct.unpack_from("<H", piece)[0] + 1
    if size != len(data):
        raise ValueError(f"a block of {len(data)} bytes says that it has {size}")
    inner = zlib.decompress(data[18:-8], -15)
    if struct.unpack("<II", data[-8:]) != (zlib.crc32(inner), len(inner)):
        raise ValueError("a block whose bytes are not those that it was made of")
    return inner


def _record_start(data: bytes, lengths: np.ndarray) -> int | None:
    """The first place at which, and in the records behind, all sizes, contigs, positions and names are possible ones."""
    if len(data) < 36:
        return None
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) - 35
    word = lambda k: sum(raw[k + b : k + b + n].astype(np.int64) << (8 * b) for b in range(4))
    signed = lambda x: np.where(x >= 1 << 31, x - (1 << 32), x)
    size, contig, pos, l_seq, mate, mate_pos = (signed(word(k)) for k in (0, 4, 8, 20, 24, 28))
    l_name, n_cigar = raw[12 : 12 + n].astype(np.int64), raw[16 : 16 + n].astype(np.int64) | raw[17 : 17 + n].astype(np.int64) << 8
    longest = np.append(lengths, np.iinfo(np.int64).max)  # a contig of -1 is the last one here
    ok = (size >= 32) & (l_seq >= 0) & (l_name > 0) & (32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq <= size)
    for c, p in ((contig, pos), (mate, mate_pos)):
        ok &= (c >= -1) & (c < len(lengths)) & (p >= -1)
        ok[ok] &= p[ok] < longest[c[ok]]

    def named(at):
        name = data[at + 36 : at + 36 + int(l_name[at])]
        return len(name) < l_name[at] or name[-1:] == b"\0" and all(33 <= b <= 126 for b in name[:-1])

    for first in np.flatnonzero(ok).tolist():
        at = first
        for _ in range(CHAIN):
            if at >= n:
                return first
            if not (ok[at] and named(at)):
                break
            at += 4 + int(size[at])
        else:
            return first
    return None


def _bam_format(names: dict[int, str], lengths: list[int], origin: int) -> pieces.Format:
    limits = np.array(lengths, np.int64)

    def spans(data, at):
        while at + 4 <= len(data):
            size = int.from_bytes(data[at : at + 4], "little", signed=True)
            if size < 32:
                raise ValueError("a record that is too short")
            if at + 4 + size > len(data):
                return
            yield at, at + 4 + size
            at += 4 + size

    def skip(data, at):
        for _, at in spans(data, at):  # noqa: B020
            pass
        return at

    def parse(data, at, final, number):
        rows = []
        for begin, at in spans(data, at):  # noqa: B020
            row = _row(names, number(begin), data[begin + 4 : at])
            if row is not None:
                rows.append(row)
        return [_batch(rows[k : k + BATCH]) for k in range(0, len(rows), BATCH)], at

    return pieces.Format(lambda blocks: b"".join(map(_unpacked, blocks)), lambda data: _record_start(data, limits), parse, skip, origin)


class _Opened:
    """The bytes of files one behind the other, read by the driver from any file system that Spark knows, from their beginning on."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        top = jvm.org.apache.hadoop.fs.Path(path)
        self.fs = top.getFileSystem(self.conf)
        status = self.fs.getFileStatus(top)
        found = list(self.fs.listStatus(top)) if status.isDirectory() else [status]
        self.files = sorted((f.getPath().toUri().toString(), f.getPath()) for f in found if f.getLen() and (not status.isDirectory() or f.getPath().getName()[0] not in "_."))
        self.indexed = any(self.fs.exists(jvm.org.apache.hadoop.fs.Path(path + end)) for end in (".bai", ".csi"))
        self.local = self.fs.getScheme() == "file"
        self.rest, self.now, self.count = [p for _, p in self.files], None, 0

    def read(self, n: int) -> bytes:
        parts = []
        while n:
            if self.now is None:
                if not self.rest:
                    break
                self.now = self.fs.open(self.rest.pop(0))
            got = bytes(self.now.readNBytes(n))
            n -= len(got)
            parts.append(got)
            if n:
                self.now.close()
                self.now = None
        return b"".join(parts)

    def close(self):
        if self.now is not None:
            self.now.close()


class _Unpacked:
    """The bytes in the blocks of `raw`; `count` of them were read."""

    def __init__(self, raw: _Opened):
        self.raw, self.held, self.count = raw, b"", 0

    def read(self, n: int) -> bytes:
        while len(self.held) < n:
            head = self.raw.read(18)
            if len(head) < 18:
                break
            if head[:16] != BLOCK:
                raise ValueError("a block that begins in another way than those of this kind of file")
            self.held += _unpacked(head[16:] + self.raw.read(struct.unpack("<H", head[16:])[0] + 1 - 18))
        got, self.held = self.held[:n], self.held[n:]
        self.count += len(got)
        return got


def bam_blocks(spark: SparkSession, path: str, chrom: str | None = None) -> DataFrame:
    """Alignments of a BAM file, or of a folder of files that follow each other by name as one, in a task for each split.

    Read through Spark's file layer, so on any file system, and without an index. Where a
    split's first record begins is found by what records look like, and held to be right
    by those of the split before (`pieces`). Blocks have to begin as the common tools write them.
    """
    opened = _Opened(spark, path)
    data = _Unpacked(opened)
    try:
        names, lengths = _contigs(data)
    finally:
        opened.close()
    wanted = {k: name for k, name in enumerate(names) if chrom in (None, name)}
    first = F.col("_metadata.file_path") == opened.files[0][0]
    found = pieces.read(spark, path, F.lit(""), first, lineSep=BLOCK.decode("latin1"), encoding="ISO-8859-1")
    return pieces.records(found, _bam_format(wanted, lengths, data.count), SCHEMA)


def write_bam(rows: DataFrame, contigs: list[tuple[str, int]], path: str) -> None:
    """Alignments (qname, flag, chrom, mapq, pos0, cigar, seq) as a folder of files that follow each other by name as one BAM.

    Qualities are left out. Contigs (name, length) are those of the header; a row of another is an error.
    """
    spark = rows.sparkSession
    numbers = {name: k for k, (name, _) in enumerate(contigs)}
    head = b"BAM\1" + struct.pack("<ii", 0, len(contigs))
    for name, length in contigs:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)

    def record(r: dict) -> bytes:
        name, seq = r["qname"].encode() + b"\0", r["seq"]
        body = struct.pack("<iiBBHHHiiii", numbers[r["chrom"]], r["pos0"], len(name), r["mapq"], 4680, len(r["cigar"]), r["flag"], len(seq), -1, -1, 0) + name
        body += struct.pack(f"<{len(r['cigar'])}I", *[c["len"] << 4 | OPERATIONS.index(c["op"]) for c in r["cigar"]])
        body += bytes.fromhex(seq.translate(TO_HEX) + "0" * (len(seq) % 2)) + b"\xff" * len(seq)
        return struct.pack("<i", len(body)) + body

    def packed(batches):
        """Blocks of a partition's records; a record runs on into the next block."""
        held = bytearray()
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                held += record(r)
                while len(held) >= BLOCK_BYTES:
                    made.append(_block(bytes(held[:BLOCK_BYTES])))
                    del held[:BLOCK_BYTES]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["block"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_block(bytes(held))], pa.binary())], names=["block"])

    one = lambda blocks: spark.createDataFrame([(bytearray(b),) for b in blocks], "block binary").coalesce(1)
    body = rows.select("qname", "flag", "chrom", "mapq", "pos0", "cigar", "seq").mapInArrow(packed, "block binary")
    whole = one([_block(head[k : k + BLOCK_BYTES]) for k in range(0, len(head), BLOCK_BYTES)]).union(body).union(one([BLOCK + END]))
    # A block ends with a zero byte, the highest of its size: what separates lines of text.
    text = whole.select(F.expr("cast(substring(block, 1, octet_length(block) - 1) AS string)").alias("value"))
    text.write.option("lineSep", "\0").text(path)


def _block(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return BLOCK + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bam(spark: SparkSession, path: str, chrom: str | None = None, split: int = SPLIT) -> DataFrame:
    """Alignments of a BAM file, or of one contig.

    With an index beside a file that executors can open, only that contig's part of the
    file is read, and a partition has about `split` bytes of it. Otherwise the file is
    read by Spark in splits (`bam_blocks`), or, if its blocks don't say their size, as one.

    The contig is an option: a filter that is pushed into a Python source stays
    with the source, also for later reads without it.
    """
    opened = _Opened(spark, path)
    blocks = opened.read(len(BLOCK)) == BLOCK
    opened.close()
    if blocks and not (opened.local and opened.indexed):
        return bam_blocks(spark, path, chrom)
    spark.dataSource.register(BamSource)
    source = spark.read.format("bam").option("split", split)
    return (source if chrom is None else source.option("chrom", chrom)).load(path)
