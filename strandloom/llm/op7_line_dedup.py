"""Removing lines that many documents share.

Line keys are hashed to 128 bits and counted once for all documents. A sharded
minimal perfect hash over the distinct hashes of frequent lines gives each a
place in compact arrays: the fingerprint, the count, and the last document.
Documents probe these arrays for their lines; lines are never joined. A small
index is broadcast. The shards of a larger one are files, in the shared folder or
fetched from it by Spark, which workers map into memory as they need them, so
that documents are read once. A shard that is missing is an error.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Pieces, documents, map_texts, pack, pieces, put_file, unpack, whole_numbers, written
from .textvec import mix

MIN_CHARS, MIN_DOCS = 40, 5
KEYS_PER_SHARD = 1 << 19
#: A key takes at most 32 bytes in its shard, so that a broadcast has a proven bound.
KEY_BYTES, BROADCAST_BYTES = 32, 32 << 20
#: Shards that a worker keeps mapped.
OPEN_SHARDS = 4096
BLANK = " \t\n\v\f\r"
NO_ID = -(1 << 63)


class PerfectHash:
    """A minimal perfect hash of (h1, h2) pairs: levels of bits, one for each key that had its place alone."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        rest, base = np.arange(len(h1)), 0
        while len(rest):
            bits = max(64, 2 * len(rest))
            at = self._place(h1[rest], h2[rest], len(self.levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            packed = np.packbits(alone, bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)
            before = base + np.cumsum(np.bitwise_count(packed), dtype=np.int64) - np.bitwise_count(packed)
            self.levels.append((bits, packed, before.astype(np.uint32)))
            base += int(alone.sum())
            rest = rest[~alone[at]]
        self.size = base

    def arrays(self) -> dict[str, np.ndarray]:
        made = {"bits": np.array([bits for bits, _, _ in self.levels], np.int64)}
        for k, (_, packed, before) in enumerate(self.levels):
            made |= {f"packed{k}": packed, f"before{k}": before}
        return made

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> PerfectHash:
        made = cls.__new__(cls)
        made.levels = [(bits, arrays[f"packed{k}"], arrays[f"before{k}"]) for k, bits in enumerate(arrays["bits"].tolist())]
        return made

    @staticmethod
    def _place(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mix(h1 + mix(h2 + np.uint64(level))) % np.uint64(bits)).astype(np.int64)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The place of each key; of others any place, or -1."""
        found, rest = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, (bits, packed, before) in enumerate(self.levels):
            at = self._place(h1[rest], h2[rest], level, bits)
            word, bit = packed[at >> 6], (at & 63).astype(np.uint64)
            there = (word >> bit) & np.uint64(1) == 1
            found[rest[there]] = (before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))))[there]
            rest = rest[~there]
        return found


def _shard(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, last: np.ndarray) -> bytes:
    perfect = PerfectHash(h1, h2)
    place = perfect.find(h1, h2)
    own = {"h1": h1, "h2": h2, "counts": counts, "last": last}
    made = {name: np.empty_like(a) for name, a in own.items()}
    for name, a in own.items():
        made[name][place] = a
    return pack({**perfect.arrays(), **made})


def line_key(line: str) -> str:
    """The line without white space at its ends; A-Z in lower case."""
    stripped = line.strip(BLANK)
    return stripped.lower() if stripped.isascii() else stripped.encode().lower().decode()


def _hashes(text: str | None, min_chars: int) -> tuple[list[int], list[bytes]]:
    """The numbers of the lines with long enough keys, and their hashes."""
    at, found = [], []
    for i, line in enumerate((text or "").split("\n")):
        if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
            at.append(i)
            found.append(xxhash.xxh3_128_digest(key.encode()))
    return at, found


def frequent_lines(df: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(h1, h2, docs, last) of the keys that at least min_docs documents (distinct ids) hold."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("h1", "h2", "id")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set(_hashes(text, min_chars)[1])
                keys += own
                ids += [NO_ID if i is None else i] * len(own)
            pairs = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(ids, pa.int64())], names=schema.names)

    lines = df.select(F.col(f"`{id_col}`").cast("long"), f"`{text_col}`").mapInArrow(run, schema)
    return lines.groupBy("h1", "h2").agg(F.count_distinct("id").alias("docs"), F.max("id").alias("last")).filter(F.col("docs") >= min_docs)


def build_index(frequent: DataFrame, shards: int, folder: str | None = None) -> DataFrame:
    """(piece, data): each shard's perfect hash with its arrays; with a folder as files there, data being null."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        data = _shard(pdf.h1.to_numpy().view(np.uint64), pdf.h2.to_numpy().view(np.uint64), np.minimum(pdf.docs.to_numpy(), 2**32 - 1).astype(np.uint32), pdf["last"].to_numpy())
        if folder:
            put_file(folder, str(pdf.shard.iloc[0]), data)
        return pd.DataFrame({"piece": [pdf.shard.iloc[0]], "data": [None if folder else data]})

    return frequent.withColumn("shard", F.pmod(F.col("h2"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(one, "piece int, data binary")


class Probe:
    """All shards on a worker: in memory, or as files."""

    def __init__(self, shards: int, data: dict[int, bytes] | Pieces):
        self.shards, self.data = shards, data
        self.open: OrderedDict = OrderedDict()

    def __getstate__(self):
        return {**self.__dict__, "open": OrderedDict()}

    def _opened(self, shard: int) -> tuple[PerfectHash, dict[str, np.ndarray]] | None:
        if (known := self.open.get(shard)) is not None:
            self.open.move_to_end(shard)
            return known
        data = self.data.open(shard) if isinstance(self.data, Pieces) else self.data.get(shard)
        if data is None:  # no frequent key falls into this shard
            return None
        arrays = unpack(data)
        self.open[shard] = PerfectHash.of(arrays), arrays
        if len(self.open) > OPEN_SHARDS:
            self.open.popitem(last=False)
        return self.open[shard]

    def last(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are frequent, and the last document that holds each of those."""
        pairs = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        h1, h2, of = pairs[:, 0].view(np.uint64), pairs[:, 1].view(np.uint64), pairs[:, 1] % self.shards
        found, last = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        order = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.diff(of[order], prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
            opened = self._opened(int(of[order[a]]))
            if opened is None:
                continue
            perfect, arrays = opened
            own = order[a:b]
            place = perfect.find(h1[own].copy(), h2[own].copy())
            at = np.maximum(place, 0)
            found[own] = (place >= 0) & (arrays["h1"][at] == h1[own]) & (arrays["h2"][at] == h2[own])
            last[own] = arrays["last"][at]
        return found, last


def _drop(batch: pa.RecordBatch, id_col: str, text_col: str, probe: Probe, min_chars: int) -> list[set[int]]:
    """The numbers of the lines that each text loses."""
    per, keys = [], []
    for text in batch.column(text_col).to_pylist():
        at, found = _hashes(text, min_chars)
        per.append(at)
        keys += found
    found, last = probe.last(keys)
    out, k = [], 0
    for i, at in zip(batch.column(id_col).to_pylist(), per):
        own = NO_ID if i is None else i
        out.append({line for j, line in enumerate(at, k) if found[j] and last[j] != own})
        k += len(at)
    return out


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, carry: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row n_lines, n_dropped and kept_text.

    Lines whose key has at least min_chars code points and stands in at least
    min_docs documents go, except in that with the largest id that holds it,
    where they all stay. Documents are told apart by their ids, which are
    integers (others are a TypeError): rows of equal id are one document, and
    each of them keeps its lines if the id is the largest; rows without an id
    are one, less than all others. A null text is one empty line, kept as ''. An
    empty table stays empty. With `carry` the other columns stay too.
    """
    whole_numbers(df, id_col)
    frequent = written(frequent_lines(df, id_col, text_col, min_chars, min_docs))
    keys = frequent.count()
    shards = max(1, -(-keys // KEYS_PER_SHARD))
    if shards * KEYS_PER_SHARD * KEY_BYTES <= max(broadcast_bytes, KEYS_PER_SHARD * KEY_BYTES):
        data = {r.piece: bytes(r.data) for r in build_index(frequent, shards).collect()} if keys else {}  # at most broadcast_bytes, or one shard
    else:
        data = pieces(df.sparkSession, lambda folder: build_index(frequent, shards, folder))
    shared = df.sparkSession.sparkContext.broadcast(Probe(shards, data))

    def run(batch: pa.RecordBatch) -> dict:
        return _kept(batch.column(text_col).to_pylist(), _drop(batch, id_col, text_col, shared.value, min_chars))

    return map_texts(df, [id_col, text_col], OUT, run, text_col, carry)


OUT = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])


def _kept(texts: list[str | None], dropped: list[set[int]]) -> dict:
    lines = [(t or "").split("\n") for t in texts]
    return {"n_lines": list(map(len, lines)), "n_dropped": list(map(len, dropped)), "kept_text": ["\n".join([x for i, x in enumerate(own) if i not in d] if d else own) for own, d in zip(lines, dropped)]}


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = """
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
lines AS (
  SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS i FROM parts),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT d.doc_id, d.line, d.i, (o.k IS NOT NULL AND o.last <> d.doc_id) AS gone
  FROM keyed d LEFT JOIN often o ON d.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
