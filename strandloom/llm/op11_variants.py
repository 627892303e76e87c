"""Grouping spelling variants: words that differ by one code point.

One edit leaves one half of a word as it is. Each word's two halves are held by
Aho-Corasick automata, in shards; every word is scanned by the automata of the
shards that can hold a half of it. A half that is met at a word's start, or at
its end, in a word of a length that one edit can give, makes a candidate, and
the rest of the two words decides. A half of very many words is held in blocks,
and the words that have it are dealt to them in blocks as well, so that no
shard grows with it. Shards give one row for each word: how many words are near,
and the most frequent one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import chunks, distinct, runs, spellings
from .common import documents, written

MIN_CHARS, MIN_COUNT, RATIO, SPOIL = 6, 5, 5, 199
#: Rows of one shard (halves held and words to scan), on average; words of one half and block.
SHARD_ROWS, BLOCK = 1 << 15, 1 << 11
#: Pairs that are verified at once; words up to WIDTH code points are compared as rows of one array.
PAIRS, WIDTH = 1 << 19, 32
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


CRC = _crc_table()


def crcs(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of the UTF-8 bytes of each run of Latin-1 characters, behind texts whose crc32 are in `state`."""
    crc = ~state.astype(np.uint32)
    order = np.argsort(-length, kind="stable")
    longer = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), "left")
    for k, n in enumerate(longer.tolist()):
        at = order[:n]
        c = data[start[at] + k]
        wide = c >= 128
        if wide.any():
            two = at[wide]
            crc[two] = CRC[(crc[two] ^ np.uint32(0xC3)) & np.uint32(255)] ^ (crc[two] >> np.uint32(8))
        c = np.where(wide, c - np.uint8(64), c).astype(np.uint32)
        crc[at] = CRC[(crc[at] ^ c) & np.uint32(255)] ^ (crc[at] >> np.uint32(8))
    return ~crc


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = 1, spoil: int | None = None) -> DataFrame:
    """(word, n): runs of Latin letters, A-Z in lower case, of at least min_chars code points, by how often they occur.

    With `spoil` a made-up misspelling is put in: where spoil divides the crc32 of
    "<id>:<run>", the run loses the code point of that number (modulo its length). A null text has no
    words, a null id is written as nothing; repeated rows count as often as they are there.
    """
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, "text"):
            texts = [(t or "").encode("latin-1", "replace") for t in rows.column("text").to_pylist()]
            data, start, length, text, _, key, check = runs([t.lower() for t in texts], LETTERS)
            if spoil is None:
                spoilt = np.zeros(len(start), bool)
                lost = np.zeros(0, np.int64)
            else:
                heads = np.array([zlib.crc32(b"%s:" % (b"" if i is None else i.encode())) for i in rows.column("id").to_pylist()], np.uint32)
                crc = crcs(heads[text], data, start, length)
                spoilt = crc % np.uint32(spoil) == 0
                lost = crc[spoilt].astype(np.int64) % length[spoilt]
            made: dict[bytes, int] = {}
            for a, n, k in zip(start[spoilt].tolist(), length[spoilt].tolist(), lost.tolist()):
                if n > min_chars:
                    word = data[a : a + n].tobytes()
                    word = word[:k] + word[k + 1 :]
                    made[word] = made.get(word, 0) + 1
            use = np.flatnonzero(~spoilt & (length >= min_chars))
            start, length = start[use], length[use]
            first, _, counts = distinct(key[use], check[use], lambda i: data[start[i] : start[i] + length[i]].tobytes())
            found = spellings(data, start[first], length[first]).to_pylist() + list(made)
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(np.concatenate([counts, np.fromiter(made.values(), np.int64, len(made))]), pa.int64())], names=schema.names)

    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _codes(words: list[str], width: int) -> np.ndarray:
    return np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)


def one_edit(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether rows of code points (0 behind the end; lengths n and m, with room for one more) are exactly one edit apart."""
    out = np.zeros(len(a), bool)
    same = np.flatnonzero(n == m)
    out[same] = np.count_nonzero(a[same] != b[same], axis=1) == 1
    for long, short, at in ((a, b, np.flatnonzero(n == m + 1)), (b, a, np.flatnonzero(m == n + 1))):
        x, y = long[at], short[at]
        before = x[:, :-1] != y[:, :-1]
        behind = x[:, 1:] != y[:, :-1]
        width = before.shape[1]
        first = np.where(before.any(1), before.argmax(1), width)
        last = np.where(behind.any(1), width - 1 - behind[:, ::-1].argmax(1), -1)
        out[at] = last < first
    return out


def _edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return len(a) == len(b) + 1 and a[k + 1 :] == b[k:]


def _search(held: pd.DataFrame, scan: pd.DataFrame) -> pd.DataFrame:
    """(word, near, form, form_n) of the scanned words of a shard, by the halves that it holds."""
    held = held.sort_values(["seg", "side"], ignore_index=True)
    group = (held.seg != held.seg.shift()) | (held.side != held.side.shift())
    low = np.flatnonzero(group.to_numpy())
    high = np.append(low[1:], len(held))
    groups: dict[str, list[int]] = {}
    for g, (seg, side) in enumerate(zip(held.seg[low], held.side[low])):
        groups.setdefault(seg, [-1, -1])[side] = g
    automaton = ahocorasick.Automaton()
    for seg, sides in groups.items():
        automaton.add_word(seg, (len(seg), *sides))
    automaton.make_automaton()
    words, known = scan.word.tolist(), held.word.tolist()
    of, met = [], []
    for v, word in enumerate(words):
        end = len(word) - 1
        for at, (size, head, tail) in automaton.iter(word):
            if at == size - 1 and head >= 0:
                of.append(v)
                met.append(head)
            if at == end and tail >= 0:
                of.append(v)
                met.append(tail)
    of, met = np.array(of, np.int64), np.array(met, np.int64)
    n, m = scan.word.str.len().to_numpy(np.int64), held.word.str.len().to_numpy(np.int64)
    size = max(n.max(initial=0), m.max(initial=0))
    width = int(min(size, WIDTH)) + 1
    short = size <= WIDTH
    a, b = _codes(words, width), _codes(known, width)
    side, blocks, block = (held[c].to_numpy() for c in ("side", "blocks", "block"))
    mark = scan["mark"].to_numpy()
    rank = np.empty(len(held), np.int64)
    rank[np.lexsort((held.word.to_numpy(), -held.n.to_numpy()))] = np.arange(len(held))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(held), np.int64)
    reps = high[met] - low[met]
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(reps) // PAIRS)) + 1).tolist(), len(reps)]
    for c, d in zip(cuts, cuts[1:]):
        own = reps[c:d]
        j = np.repeat(low[met[c:d]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        i = np.repeat(of[c:d], own)
        fit = (np.abs(n[i] - m[j]) <= 1) & (mark[i] % blocks[j] == block[j])
        i, j = i[fit], j[fit]
        good = np.zeros(len(i), bool)
        wide = np.zeros(len(i), bool) if short else (n[i] > WIDTH) | (m[j] > WIDTH)
        x, y = a[i], b[j]
        differ = np.where(wide[:, None], True, x != y)
        first = differ.argmax(1)
        # A pair that both halves give counts by the first one.
        both = (side[j] == 1) & (first >= m[j] // 2) & ~wide
        good[~wide] = one_edit(x[~wide], y[~wide], n[i[~wide]], m[j[~wide]])
        good &= ~both
        for k in np.flatnonzero(wide).tolist():
            v, w = words[i[k]], known[j[k]]
            good[k] = _edit(v, w) and not (side[j[k]] == 1 and v[: len(w) // 2] == w[: len(w) // 2])
        i, j = i[good], j[good]
        near += np.bincount(i, minlength=len(words))
        np.minimum.at(best, i, rank[j])
    found = np.flatnonzero(near)
    form = np.argsort(rank)[best[found]]
    return pd.DataFrame({"word": scan.word.to_numpy()[found], "near": near[found], "form": held.word.to_numpy()[form], "form_n": held.n.to_numpy()[form]})


def near_words(words: DataFrame, shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near ones; form is the near word of largest n.

    words: (word, n), distinct, of at least two code points each. At a tie of n the
    form is the first in the order of code points.
    """
    size, w = F.length("word"), F.col("word")
    sizes = F.filter(F.array(size - 1, size, size + 1), lambda k: k >= 2)
    half = F.expr("length(word) div 2")
    holds = F.array(*[F.struct(F.lit(0).alias("side"), F.substring(w, F.lit(1), half).alias("seg")), F.struct(F.lit(1).alias("side"), F.substring(w, half + 1, size).alias("seg"))])
    heads = F.array_distinct(F.transform(sizes, lambda k: F.struct(F.lit(0).alias("side"), F.substring(w, F.lit(1), F.floor(k / 2).cast("int")).alias("seg"))))
    tails = F.array_distinct(F.transform(sizes, lambda k: F.struct(F.lit(1).alias("side"), F.substring(w, size - F.ceil(k / 2).cast("int") + 1, size).alias("seg"))))
    parts = F.array(F.struct(F.lit(True).alias("holds"), holds.alias("segs")), F.struct(F.lit(False).alias("holds"), F.concat(heads, tails).alias("segs")))
    routed = words.select("word", "n", F.pmod(F.xxhash64("word"), F.lit(1 << 40)).alias("mark"), F.explode(parts).alias("p")).select("word", "n", "mark", "p.holds", F.explode("p.segs").alias("s")).select("word", "n", "mark", "holds", "s.side", "s.seg")
    routed = written(routed)
    per = routed.groupBy("side", "seg").agg(F.count_if("holds").alias("held"), F.count_if(~F.col("holds")).alias("scans"))
    per = per.filter("held > 0 AND scans > 1").select("side", "seg", F.ceil(F.col("held") / block).cast("long").alias("held_blocks"), F.ceil(F.col("scans") / block).cast("long").alias("blocks"))
    cells = routed.join(per, ["side", "seg"])
    own = F.when(F.col("holds"), F.pmod("mark", F.col("held_blocks"))).otherwise(F.pmod("mark", F.col("blocks")))
    others = F.when(F.col("holds"), F.col("blocks")).otherwise(F.col("held_blocks"))
    cells = cells.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
    shards = max(1, -(-routed.count() // shard_rows))
    held_block, scan_block = F.when(F.col("holds"), F.col("own")).otherwise(F.col("other")), F.when(F.col("holds"), F.col("other")).otherwise(F.col("own"))
    cells = cells.select(F.pmod(F.xxhash64("side", "seg", held_block, scan_block), F.lit(shards)).alias("shard"), "holds", "side", "seg", "word", "n", "mark", "blocks", scan_block.alias("block"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf[pdf.holds]
        return _search(held, pdf[~pdf.holds].drop_duplicates("word"))

    found = cells.groupBy("shard").applyInPandas(search, "word string, near long, form string, form_n long")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("w"))).alias("b")).select("word", "n_near", F.col("b.w").alias("form"), (-F.col("b.n")).alias("form_n"))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root): from each word of (word, form) along the forms to the last; no way has more than `most` steps."""
    ways = written(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(max(1, most)))):  # each round doubles the steps
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = written(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return ways


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words (word, n).

    form is the near word of largest n, at a tie the first, if that is at least
    ratio (2 or more) times the word's own n; root is the last form on the way. A word
    without one is its own root. An empty table gives an empty one; the words
    must be distinct, not null, and of at least two code points.
    """
    if ratio < 2:
        raise ValueError("ratio has to be at least 2, so that forms have an end")
    words = written(words.select("word", "n"))
    most, least = words.agg(F.max("n"), F.min("n")).first()
    kept = F.col("form_n") >= ratio * F.col("n")
    made = written(words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(kept, F.col("form")).alias("form"), F.when(kept, F.col("form_n")).alias("form_n")))
    ways = roots(made.filter("form IS NOT NULL"), int(math.log((most or 1) / max(1, least or 1)) / math.log(ratio)) + 1)
    return made.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(documents(spark, sf_dir), min_count=MIN_COUNT, spoil=SPOIL))


OP11_SQL = """
WITH RECURSIVE steps AS (
  SELECT i::UBIGINT AS i, i::UBIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
lowered AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM found GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
    flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::UBIGINT] ELSE [195::UBIGINT, (ord(c) - 64)::UBIGINT] END))),
    lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)::BIGINT]))) AS h FROM lowered, crc),
spoilt AS (
  SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM spoilt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (
  SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest,
    substring(word, 1, i - 1) || '_' || substring(word, i + 1) AS gap FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS form, b.n AS form_n FROM cut a JOIN cut b ON a.gap = b.gap AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY form_n DESC, form) AS k FROM pairs),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
    CASE WHEN r.form_n >= 5 * w.n THEN r.form END AS form, CASE WHEN r.form_n >= 5 * w.n THEN r.form_n END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r ON w.word = r.word),
ways AS (
  SELECT word, word AS root, 0 AS k FROM formed
  UNION ALL SELECT w.word, f.form, k + 1 FROM ways w JOIN formed f ON w.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT word, arg_max(root, k) AS root FROM ways GROUP BY word) r ON f.word = r.word
"""
