"""Mining collocations with hashed buckets, a language at a time.

Phrases grow by one word a pass. While a pass counts the phrases of k words, it
also hashes those of k + 1 words to buckets and counts these; a phrase can only be
frequent if its bucket is. The buckets that are go to a bitmap, which is broadcast, and so do
the frequent phrases of each length. The next pass counts exactly, by its words, what has both
of its shorter parts among the frequent ones and a frequent bucket; what else
falls into such buckets costs time only. Bitmaps are sized by the input, and by BITS at
most: beyond that they let more through, and the counts stay exact.

A phrase's score compares it with its two parts at each cut; the lowest one counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import chunks, distinct, runs, spellings
from .common import documents, dropped, written
from .textvec import mix

MAX_WORDS, MIN_COUNT, TOP, COVER = 3, 10, 2000, 50
#: Bits of a bucket number, at least and at most: a bitmap of 2**30 takes 128 MB.
FEWEST_BITS, BITS = 20, 30
#: Buckets of one part of a bitmap.
PART_BITS = 16
#: The best phrases are found in so many heaps for each language, and among those the best of all.
HEAPS = 32
APART, INNER = np.zeros(256, bool), np.ones(256, bool)
APART[list(b".,;:!?\n\v\f\r")] = True
INNER[[*b".,;:!?\n\v\f\r", *b" \t"]] = False
SCHEMA = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("h", T.LongType()), T.StructField("n", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("data", T.BinaryType())]
)


class Bitmap:
    """Numbered bits of 64-bit hashes; a hash's number is its upper bits."""

    def __init__(self, bits: int, parts: list[tuple[int, bytes]]):
        self.shift = np.uint64(64 - bits)
        self.words = np.zeros(1 << (bits - 6), np.uint64)
        size = 1 << (PART_BITS - 6)
        for part, data in parts:
            self.words[part * size : (part + 1) * size] = np.frombuffer(data, "<u8")

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _parts(h: np.ndarray, counts: np.ndarray, bits: int, most: int) -> tuple[list[int], list[bytes]]:
    """The buckets of hashes with their counts (most at most, which is enough), by parts of the bitmap: 3 bytes for each."""
    at, number = np.unique(h >> np.uint64(64 - bits), return_inverse=True)
    total = np.minimum(np.bincount(number, np.minimum(counts, most), len(at)), most).astype(np.uint8)
    part = (at >> np.uint64(PART_BITS)).astype(np.int64)
    edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(at)).tolist()
    low = (at & np.uint64((1 << PART_BITS) - 1)).astype("<u2")
    return part[edges[:-1]].tolist(), [low[a:b].tobytes() + total[a:b].tobytes() for a, b in zip(edges, edges[1:])]


def _bitmap(parts: DataFrame, bits: int, least: int) -> Bitmap:
    """The buckets that reach `least`; each part is summed as a stream of rows, in 64 K counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(1 << PART_BITS, np.int64)
        for batch in batches:
            made = []
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != now:
                    if now is not None:
                        made.append((now, np.packbits(sums >= least, bitorder="little").tobytes()))
                    now, sums = part, np.zeros(1 << PART_BITS, np.int64)
                n = len(data) // 3
                sums[np.frombuffer(data, "<u2", n)] += np.frombuffer(data, np.uint8, n, 2 * n)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.int32()), pa.array([d for _, d in made], pa.binary())], names=["part", "data"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()])], names=["part", "data"])

    rows = parts.select("part", "data").repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, data binary").collect()
    return Bitmap(bits, [(r.part, bytes(r.data)) for r in rows])  # 2**bits bits at most


def _of_hashes(frequent: DataFrame, bits: int) -> Bitmap:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            part, data = _parts(h, np.ones(len(h), np.int64), bits, 1)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

    return _bitmap(frequent.select("h").mapInArrow(run, "part int, data binary"), bits, 1)


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word."""
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + word)


def _pass(rows: DataFrame, k: int, max_words: int, min_count: int, bits: int, known: list[Bitmap], buckets: Bitmap | None) -> DataFrame:
    """Counts of phrases of k words from each chunk of texts, and of buckets of longer ones.

    known: the frequent phrases of 1 to k - 1 words; buckets: those of k words.
    """
    shared = rows.sparkSession.sparkContext.broadcast((known, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, buckets = shared.value
        for chunk in chunks(batches, "text"):
            texts = [t.lower() for t in chunk.column("text").cast(pa.large_binary()).to_pylist()]  # A-Z only, as these are bytes
            named = chunk.column("lang").combine_chunks().dictionary_encode()
            langs = named.dictionary.to_pylist()
            seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in langs], np.uint64)
            lang = named.indices.to_numpy()
            data, start, length, text, piece, key, check = runs(texts, INNER, APART)
            own = lang[text]
            key, check = mix(key ^ seeds[own]), check + seeds[own]
            first, word, counts = distinct(key, check, lambda i: (own[i], data[start[i] : start[i] + length[i]].tobytes()))
            spelt = spellings(data, start[first], length[first]).cast(pa.large_string())
            h1, lang1 = key[first], pa.array(langs, pa.string()).take(pa.array(own[first]))
            del data, start, length, text, key, check
            h, number, places = h1, word, np.arange(len(word))
            good = known[0].has(h1)[word] if k > 1 else np.ones(len(word), bool)
            for j in range(2, k + 1):
                first, counts, h, number, places = _grown(number, good, word, piece, h, h1, j)
                passes = (known[j - 1] if j < k else buckets).has(h)
                good = np.zeros(len(word), bool)
                good[places] = passes[number[places]]
            chosen = np.flatnonzero(passes) if k > 1 else np.arange(len(first))
            first = first[chosen]
            phrase = pc.binary_join_element_wise(*[spelt.take(pa.array(word[first + j])) for j in range(k)], pa.scalar(" ", pa.large_string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang1.take(pa.array(word[first])), phrase, pa.array(h[chosen].view(np.int64)), pa.array(counts[chosen], pa.int64()), pa.nulls(len(first), pa.int32()), pa.nulls(len(first), pa.binary())], names=SCHEMA.names)
            if k < max_words:
                _, counts, h, _, _ = _grown(number, good, word, piece, h, h1, k + 1)
                part, packed = _parts(h, counts, bits, min_count)
                none = len(part)
                yield pa.RecordBatch.from_arrays([pa.nulls(none, pa.string()), pa.nulls(none, pa.string()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.array(part, pa.int32()), pa.array(packed, pa.binary())], names=SCHEMA.names)

    return rows.mapInArrow(run, SCHEMA)


def _grown(number: np.ndarray, good: np.ndarray, word: np.ndarray, piece: np.ndarray, h: np.ndarray, h1: np.ndarray, j: int) -> tuple[np.ndarray, ...]:
    """The distinct phrases of j words whose two parts of j - 1 words are good.

    number: the number of the shorter phrase at each place. Gives a place of each phrase, its count and hash, the
    number of the phrase at each place, and the places.
    """
    at = np.flatnonzero(good[: max(0, len(word) - 1)] & good[1:])
    at = at[at + j <= len(word)]
    at = at[piece[at] == piece[at + j - 1]]
    both = number[at] * (int(word.max(initial=0)) + 1) + word[at + j - 1]
    _, first, own, counts = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    numbers = np.zeros(len(word), np.int64)
    numbers[at] = own
    first = at[first]
    return first, counts, _longer(h[number[first]], h1[word[first + j - 1]]), numbers, at


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def phrase_counts(df: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, n) of all phrases of 1 to max_words words that occur min_count times (2 to 255) or more, and (lang, n) of all words.

    A null lang is `und`, a null text has no words. A-Z are lower-cased.
    """
    if not 2 <= min_count <= 255:
        raise ValueError("min_count has to be from 2 to 255")
    rows = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bits = min(BITS, max(FEWEST_BITS, size.bit_length() - 2))
    known: list[Bitmap] = []
    buckets, levels, total = None, [], None
    for k in range(1, max_words + 1):
        found = written(_pass(rows, k, max_words, min_count, bits, known, buckets))
        counted = found.filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.first("h").alias("h"))
        if k == 1:
            total = written(found.filter("phrase IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")))
        counted = written(counted.filter(F.col("n") >= min_count))
        levels.append(counted.select("lang", F.lit(k).alias("k"), "phrase", "n"))
        if k < max_words:
            known.append(_of_hashes(counted, bits))
            buckets = _bitmap(found.filter("phrase IS NULL"), bits, min_count)
        dropped(found)
    made = levels[0]
    for level in levels[1:]:
        made = made.unionByName(level)
    return made, total


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, cover: int = COVER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language by score, then a, then phrase.

    a, l, r: how often the phrase and its two parts at the cut of the lowest
    score occur; n: all words of the language; score: 1000000 a a / (l r), rounded
    down. A phrase that lies in a longer one, which has at least `cover` per cent
    of its occurrences, gives way to it. Repeated rows count each time; an empty table
    gives none. Texts may be null or empty, and so may langs (null is `und`).
    """
    counts, total = phrase_counts(df, lang_col, text_col, max_words, min_count)
    phrases = counts.filter("k > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    size = F.size("w")
    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _joined(F.slice("w", F.lit(1), F.col("cut"))).alias("left"), _joined(F.slice("w", F.col("cut") + 1, size)).alias("right"))
    part = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    cuts = cuts.join(part, ["lang", "left"]).join(part.toDF("lang", "right", "r"), ["lang", "right"])
    score = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m"))
    longer = phrases.filter(size > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), size - 1)).alias("k"))
    longer = longer.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), size - F.col("k") + 1), lambda i: _joined(F.slice("w", i, F.col("k"))))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("over") < cover * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score", F.pmod(F.xxhash64("phrase"), F.lit(HEAPS)).alias("heap"))
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    for parts in (("lang", "heap"), ("lang",)):  # Spark keeps the first rows of each task before it deals them out
        kept = kept.withColumn("rank", F.row_number().over(W.partitionBy(*parts).orderBy(*order))).filter(F.col("rank") <= top)
    return kept.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP12_SQL = """
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
cut AS (SELECT lang, d, regexp_split_to_array(t, '[.,;:!?\\n\\x0B\\f\\r]') AS p FROM docs),
pieces AS (SELECT lang, d, unnest(range(len(p))) AS i, unnest(p) AS piece FROM cut),
split AS (
  SELECT lang, d, i, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
words AS (SELECT lang, d, i, unnest(range(len(w))) AS pos, unnest(w) AS w FROM split),
grams AS (
  SELECT lang, w, lead(w, 1) OVER (PARTITION BY d, i ORDER BY pos) AS w2, lead(w, 2) OVER (PARTITION BY d, i ORDER BY pos) AS w3 FROM words),
f1 AS (SELECT lang, w AS phrase, count(*) AS n FROM grams GROUP BY ALL),
f2 AS (SELECT lang, w || ' ' || w2 AS phrase, w, w2, count(*) AS n FROM grams WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (
  SELECT lang, w || ' ' || w2 || ' ' || w3 AS phrase, w, w2, w3, count(*) AS n FROM grams WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT lang, phrase, n AS a, 1 AS k, w AS x, w2 AS y FROM f2 WHERE n >= 10
  UNION ALL SELECT lang, phrase, n, 1, w, w2 || ' ' || w3 FROM f3
  UNION ALL SELECT lang, phrase, n, 2, w || ' ' || w2, w3 FROM f3),
f AS (SELECT lang, phrase, n FROM f1 UNION ALL SELECT lang, phrase, n FROM f2),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.n AS l, r.n AS r,
    ((1000000::HUGEINT * c.a * c.a) // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM cuts c JOIN f l ON c.lang = l.lang AND c.x = l.phrase JOIN f r ON c.lang = r.lang AND c.y = r.phrase),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(n) AS most FROM (
    SELECT lang, w || ' ' || w2 AS phrase, n FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, n FROM f3) GROUP BY ALL),
kept AS (
  SELECT s.* FROM lowest s LEFT JOIN longer o ON s.lang = o.lang AND s.phrase = o.phrase
  WHERE o.most IS NULL OR 100 * o.most < 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n, k.score FROM ranked k JOIN total t ON k.lang = t.lang WHERE k.rank <= 2000
"""
