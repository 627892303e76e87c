"""Document fingerprints by locally consistent parsing.

A text's bytes are cut into phrases and each phrase gets a name, again and
again over the names. Where to cut is settled by deterministic coin tossing: a
symbol is relabelled by the lowest bit in which it differs from the one before
it, twice more for the labels, and phrases begin where labels are greatest among
their neighbours. Cuts depend on a few symbols around them only, so equal
substrings get equal phrases in their interior wherever they stand. The least
names of a level make the fingerprint.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, documents, map_texts, whole_numbers
from .textvec import mix, sequences

LEVELS, KEPT = 2, 64
NAME_DIGITS = 8
NO_ID = -(1 << 63)


def _toss(n: int) -> np.ndarray:
    """The new label for each pair (label before, label) below n."""
    before, own = np.arange(n)[:, None], np.arange(n)[None, :]
    differ = before ^ own
    low = differ & -differ
    place = np.bitwise_count(np.maximum(low, 1) - 1)
    return (2 * place + ((own & low) != 0)).astype(np.uint8).ravel()


AGAIN, THIRD = _toss(128), _toss(16)


def parse(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each text's symbols, and where each text's names begin.

    first: where each text's symbols begin, and the end. Runs of a symbol count as one symbol of their own.
    """
    if not len(symbols):
        return symbols, first
    own = first[:-1][np.diff(first) > 0]
    new = np.ones(len(symbols), bool)
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[own] = True
    at = np.flatnonzero(new)
    run = np.diff(at, append=len(symbols))
    x = symbols[at]
    many = run > 1
    x[many] = mix(x[many] + run[many].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    first = np.searchsorted(at, first)
    own = first[:-1][np.diff(first) > 0]
    differ = x[1:] ^ x[:-1]
    low = differ & (~differ + np.uint64(1))
    label = np.zeros(len(x), np.uint8)
    label[1:] = np.minimum(2 * np.bitwise_count(low - np.uint64(1)) + ((x[1:] & low) != 0), 127)  # only across two texts can symbols be equal
    label[1:] = AGAIN[(label[:-1].astype(np.uint16) << 7) | label[1:]]
    label[1:] = THIRD[(label[:-1].astype(np.uint16) << 4) | label[1:]]
    cut = np.zeros(len(x), bool)
    cut[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    for k in range(4):  # labels so near to a text's start lean on the text before it
        near = own + k
        cut[near[near < len(x)]] = False
    cut[np.maximum(first[1:] - 1, 0)] = False
    cut[own] = True
    start = np.flatnonzero(cut)
    return mix(sequences(mix(x), start) + np.diff(start, append=len(x)).astype(np.uint64)), np.searchsorted(start, first)


def names(texts: list[bytes], levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """The names of the phrases of the given level."""
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=first[1:])
    symbols = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    for _ in range(levels):
        symbols, first = parse(symbols, first)
    return symbols, first


def sketches(texts: list[bytes], levels: int = LEVELS, kept: int = KEPT) -> list[np.ndarray]:
    """The least `kept` distinct names of each text, ascending, as 32-bit numbers. Of an empty text: none."""
    found, first = names(texts, levels)
    short = (found >> np.uint64(32)).astype(np.uint32)
    out = []
    for a, b in zip(first, first[1:]):
        own = short[a:b]
        out.append(np.unique(own)[:kept])
    return out


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """The share of names that two texts have in common (of both: twice the common ones by the sum), from their sketches."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:kept]
    common = len(np.intersect1d(np.intersect1d(union, a, True), b, True))
    j = common / len(union)
    return round(2 * j / (1 + j), 6)


def text_of(sketch: np.ndarray) -> str:
    """The fingerprint: each name as eight hex digits."""
    return sketch.astype(">u4").tobytes().hex()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int = LEVELS, kept: int = KEPT, carry: bool = False) -> DataFrame:
    """The fingerprint of every row's text.

    Equal texts have equal fingerprints; a null text counts as empty, whose
    fingerprint is the empty string. Repeated rows each get theirs; an empty
    table stays empty.
    """
    schema = T.StructType([T.StructField("fingerprint", T.StringType())])
    return map_texts(df, [id_col, text_col], schema, lambda batch: {"fingerprint": [text_of(s) for s in sketches([(t or "").encode("utf-8", "replace") for t in batch.column(text_col).to_pylist()], levels, kept)]}, text_col, carry)


def fingerprint_likeness(a: Column, b: Column, kept: int = KEPT) -> Column:
    """`likeness` of two columns of fingerprints."""
    def parts(c: Column) -> Column:
        n = (F.length(c) / NAME_DIGITS).cast("int")
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(c, i * NAME_DIGITS + 1, F.lit(NAME_DIGITS))))

    left, right = parts(a), parts(b)
    union = F.slice(F.array_sort(F.array_union(left, right)), 1, kept)
    j = F.size(F.array_intersect(F.array_intersect(union, left), right)) / F.size(union)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.round(2 * j / (1 + j), 6))


def _edges(ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Composite edges (id, hash) from quantiles of ids: an id that is r of them is cut at r places of its rows' hashes."""
    made = []
    for value, group in itertools.groupby(sorted(ids)):
        r = len(list(group))
        made += [(value, -(1 << 63) + (k + 1) * ((1 << 64) // (r + 1))) for k in range(r)]
    return np.array([i for i, _ in made], np.int64), np.array([h for _, h in made], np.int64)


def _part(ids: np.ndarray, hashes: np.ndarray, edges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many edges are at or before each (id, hash)."""
    low, high = np.searchsorted(edges[0], ids, "left"), np.searchsorted(edges[0], ids, "right")
    out = low.copy()
    on = np.flatnonzero(high > low)
    for a in np.unique(low[on]).tolist():
        own = on[low[on] == a]
        out[own] += np.searchsorted(edges[1][a : high[own[0]]], hashes[own], "right")
    return out


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows sorted by id and by a hash of the text, in ranges; each range is one partition and followed by the first row of the next.

    Columns id, text, no_id, part, extra: 1 on the row that only serves as the
    one after the last. An id of very many rows is spread over ranges by their
    texts' hashes; only rows that are wholly equal always share a range.
    """
    whole_numbers(df, id_col)
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"), F.col(f"`{id_col}`").isNull().alias("no_id"))
    found = rows.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)] or [0.5], 10 * parts)).first()[0] or []
    edges = _edges(found if parts > 1 else [])  # at most one edge for each part

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(_part(ids.to_numpy(), hashes.to_numpy(), edges), dtype="int32")

    @F.pandas_udf("int")
    def also_in(ids: pd.Series, hashes: pd.Series, part: pd.Series) -> pd.Series:
        """The range before, for the rows with which a range begins; -1 for others."""
        place = np.minimum(np.searchsorted(begun, part.to_numpy()), len(begun) - 1)
        is_first = (first_id[place] == ids.to_numpy()) & (first_hash[place] == hashes.to_numpy())
        return pd.Series(np.where(is_first, before[place], -1), dtype="int32")

    placed = rows.withColumn("part", range_of("id", "hash"))
    firsts = sorted(placed.groupBy("part").agg(F.min(F.struct("id", "hash")).alias("first")).collect())  # at most one row for each part
    if not firsts:
        return placed.withColumn("extra", F.lit(0)).select("id", "text", "no_id", "part", "extra")
    begun = np.array([r.part for r in firsts])
    first_id, first_hash = (np.array([r.first[k] for r in firsts], np.int64) for k in (0, 1))
    before = np.concatenate([begun[-1:], begun[:-1]])  # behind the last range comes the first
    also = placed.withColumn("also", also_in("id", "hash", "part"))
    copies = F.filter(F.array(F.struct(F.col("part"), F.lit(0).alias("extra")), F.struct(F.col("also").alias("part"), F.lit(1).alias("extra"))), lambda c: c["part"] >= 0)
    return (
        also.select("id", "hash", "text", "no_id", F.inline(copies))
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions("part", "extra", "id", "hash", "text")
        .select("id", "text", "no_id", "part", "extra")
    )


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int = LEVELS, kept: int = KEPT) -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness; and the likeness to the next document.

    The edited form has the last half of the text's code points (rounded down)
    replaced by as many from the start of the next document in ascending order
    of ids, or by all it has; after the last comes the first, and a single
    document is its own next. A null text counts as empty. Null ids come first;
    rows of equal id follow each other in the order of their texts' hashes
    (xxhash64). Ids are integers; others are a TypeError.
    """
    schema = T.StructType([df.schema[id_col], *[T.StructField(n, t) for n, t in (("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))]])
    id_type = pa.int64()
    cast_to = schema[0].dataType

    def pairs(rows: list[tuple], made: list[np.ndarray]) -> pa.RecordBatch:
        """rows: (id, text, extra) in order; each but the last and the extra ones is paired with the one behind it."""
        keep = [k for k in range(len(rows) - 1) if not rows[k][2]]
        edited = []
        for k in keep:
            text, after = rows[k][1], rows[k + 1][1]
            half = len(text) // 2
            edited.append((text[: len(text) - half] + after[:half]).encode("utf-8", "replace"))
        new = sketches(edited, levels, kept)
        return pa.RecordBatch.from_arrays([
            pa.array([rows[k][0] for k in keep], id_type),
            pa.array([len(rows[k][1]) for k in keep], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            pa.array([text_of(made[k]) for k in keep], pa.string()),
            pa.array([text_of(s) for s in new], pa.string()),
            pa.array([likeness(made[k], s, kept) for k, s in zip(keep, new)], pa.float64()),
            pa.array([likeness(made[k], made[k + 1], kept) for k in keep], pa.float64()),
        ], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        made: list[np.ndarray] = []
        size, part = 0, None

        def done() -> pa.RecordBatch:
            made.extend(sketches([r[1].encode("utf-8", "replace") for r in rows[len(made) :]], levels, kept))
            out = pairs(rows, made)
            del rows[:-1], made[:-1]
            return out

        for batch in batches:
            for i, text, no_id, p, extra in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part and rows:
                    yield done()
                    rows.clear()
                    made.clear()
                    size = 0
                part = p
                if rows and rows[-1][2]:  # one row after the last is enough
                    continue
                rows.append((None if no_id else i, text, extra))
                size += len(text)
                if size > SLICE_BYTES:
                    yield done()
                    size = 0
        if rows:
            yield done()

    plain = T.StructType([T.StructField(id_col, T.LongType()), *schema.fields[1:]])
    return with_next(df, id_col, text_col).mapInArrow(run, plain).withColumn(id_col, F.col(id_col).cast(cast_to))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(documents(spark, sf_dir))
