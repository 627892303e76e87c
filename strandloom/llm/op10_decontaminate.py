"""Finding benchmark passages in documents by greedy string tiling.

Windows of words that a document shares with a benchmark item are seeds. On the
words under seeds, Karp-Rabin search finds the longest matches that overlap no
earlier one and marks them, for shorter and shorter lengths; what share of the
item's words is marked decides. Passages whose parts stand in another order are
found as well. A small benchmark is broadcast. A larger one is cut into blocks
of a bounded size: files, in the shared folder or fetched from it by Spark,
which workers map into memory, so that documents are read once.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Pieces, documents, map_texts, pack, pieces, put_file, unpack, whole_numbers
from .textvec import shingles, words

MIN_MATCH, COVERAGE = 5, 0.8
#: Bytes of benchmark text in one block (a larger item is a block of its own).
BLOCK_BYTES = 8 << 20
#: Places in items that are counted at once.
MET = 1 << 21
PRIME, RADIX = (1 << 61) - 1, 1_000_003
OTHER = re.compile(r"\W+")
INNER = np.zeros(256, bool)
INNER[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def plain(text: str | None) -> bytes:
    """Lower case; words are runs of letters, digits and underscores."""
    text = (text or "").lower()
    return (text if text.isascii() else OTHER.sub(" ", text)).encode("utf-8", "replace")


def _rolling(values: list[int], free: list[bool], n: int):
    """The Karp-Rabin hash of every window of n free places: (start, hash)."""
    out, h, top, run = [], 0, pow(RADIX, n - 1, PRIME), 0
    for i, v in enumerate(values):
        if not free[i]:
            h, run = 0, 0
            continue
        if run == n:
            h = (h - values[i - n] * top) % PRIME
            run -= 1
        h = (h * RADIX + v) % PRIME
        run += 1
        if run == n:
            out.append((i - n + 1, h))
    return out


def tiles(item: list[int], text: list[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in text, length): longest first, none shorter than min_match, none overlapping.

    Among matches of one length the first in the item goes first, and then the first in the text.
    """
    free_item, free_text = [True] * len(item), [True] * len(text)
    found: list[tuple[int, int, int]] = []
    length = max(min_match, min(len(item), len(text), 4 * min_match))
    while True:
        table = defaultdict(list)
        for i, h in _rolling(text, free_text, length):
            table[h].append(i)
        matches: dict[int, list[tuple[int, int]]] = defaultdict(list)
        longest = length
        for a, h in _rolling(item, free_item, length):
            for b in table.get(h, ()):
                if item[a : a + length] != text[b : b + length]:
                    continue
                n = length
                while a + n < len(item) and b + n < len(text) and free_item[a + n] and free_text[b + n] and item[a + n] == text[b + n]:
                    n += 1
                matches[n].append((a, b))
                longest = max(longest, n)
        if longest > 2 * length:  # search for the long ones first
            length = longest
            continue
        for n in sorted(matches, reverse=True):
            for a, b in matches[n]:
                if all(free_item[a : a + n]) and all(free_text[b : b + n]):
                    free_item[a : a + n] = free_text[b : b + n] = [False] * n
                    found.append((a, b, n))
        # A match that lost a part to a longer one may have enough left: each length is searched until none is left.
        if not matches:
            if length == min_match:
                return found
            length = max(min_match, length // 2)


class Block:
    """Benchmark items with their seeds, as arrays: words, and for each seed length its windows in order with item and place."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.lengths = arrays["lengths"].tolist()

    @classmethod
    def of(cls, items: list[tuple[int, str | None]], min_match: int) -> Block:
        hashes, _, _, first = words([plain(t) for _, t in items], lower=False, inner=INNER)
        sizes = np.diff(first)
        made = {"ids": np.array([i for i, _ in items], np.int64), "words": hashes, "first": first.astype(np.int64)}
        by_length = np.minimum(sizes, min_match)
        lengths = sorted(set(by_length[sizes > 0].tolist()))
        for n in lengths:
            chosen = np.flatnonzero(by_length == n)
            flat = np.concatenate([hashes[first[k] : first[k + 1]] for k in chosen])
            windows, at = shingles(flat, np.concatenate([[0], np.cumsum(sizes[chosen])]), n)
            order = np.argsort(windows, kind="stable")
            made[f"windows{n}"] = windows[order]
            made[f"of{n}"] = np.repeat(chosen, np.diff(at))[order].astype(np.int32)
            made[f"place{n}"] = (np.arange(len(windows)) - np.repeat(at[:-1], np.diff(at)))[order].astype(np.int32)
            seen = np.zeros(1 << 20, bool)
            seen[(windows >> np.uint64(44)).astype(np.int64)] = True
            made[f"seen{n}"] = seen
        return cls({**made, "lengths": np.array(lengths, np.int64)})

    def _pairs(self, n: int, windows: np.ndarray, text: np.ndarray, coverage: float) -> list[tuple[int, int]]:
        """(text, item) with so many distinct seeds in common that tiles may reach the coverage."""
        new = np.ones(len(windows), bool)
        order = np.lexsort((windows, text))
        windows, text = windows[order], text[order]
        new[1:] = (windows[1:] != windows[:-1]) | (text[1:] != text[:-1])  # a window that a text repeats counts once
        windows, text = windows[new], text[new]
        known, of = self.arrays[f"windows{n}"], self.arrays[f"of{n}"]
        low, high = np.searchsorted(known, windows, "left"), np.searchsorted(known, windows, "right")
        sizes, out = np.diff(self.arrays["first"]), []
        edges = [0, *(np.flatnonzero(np.diff(text)) + 1).tolist(), len(text)]
        for a, b in zip(edges, edges[1:]):
            # Counted piece by piece, so that seeds of very many items take bounded memory.
            met = np.zeros(len(sizes), np.int64)
            reps = high[a:b] - low[a:b]
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(reps) // MET)) + 1).tolist(), len(reps)]
            for c, d in zip(cuts, cuts[1:]):
                own = reps[c:d]
                at = np.repeat(low[a + c : a + d] - (np.cumsum(own) - own), own) + np.arange(own.sum())
                met += np.bincount(of[at], minlength=len(sizes))
            # A seed that an item holds twice is met at both places. Each covers n words at most.
            out += [(int(text[a]), int(k)) for k in np.flatnonzero((met > 0) & (met * n >= coverage * sizes))]
        return out

    def hits(self, hashes: np.ndarray, first: np.ndarray, coverage: float) -> list[list[tuple[float, int]]]:
        """For each text (share of the item's words under tiles, item id) of the items that reach the coverage."""
        out: list[list[tuple[float, int]]] = [[] for _ in range(len(first) - 1)]
        starts = self.arrays["first"]
        for n in self.lengths:
            own, at = shingles(hashes, first, n)
            known = self.arrays[f"windows{n}"]
            maybe = np.flatnonzero(self.arrays[f"seen{n}"][(own >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(known, own[maybe]), len(known) - 1)
            maybe = maybe[known[place] == own[maybe]]
            if not len(maybe):
                continue
            text = np.searchsorted(at, maybe, "right") - 1
            for t, k in self._pairs(n, own[maybe], text, coverage):
                item = self.arrays["words"][starts[k] : starts[k + 1]]
                seeds = shingles(item, np.array([0, len(item)]), n)[0]
                here = maybe[np.searchsorted(text, t, "left") : np.searchsorted(text, t, "right")]
                here = here[np.isin(own[here], seeds)]
                # Tiles lie under seeds, so that fewer words under seeds can't reach the coverage.
                if _under(np.flatnonzero(np.isin(seeds, own[here])), n, len(item)).sum() < coverage * len(item):
                    continue
                size = int(first[t + 1] - first[t])
                under = np.flatnonzero(_under(here - at[t], n, size))
                part: list[int] = []
                for run in np.split(under, np.flatnonzero(np.diff(under) > 1) + 1):
                    part += [-1] * bool(part)  # no tile runs over words that no seed covers
                    part += hashes[first[t] + run].tolist()
                covered = sum(x for _, _, x in tiles(item.tolist(), part, n)) / len(item)
                if covered >= coverage:
                    out[t].append((covered, int(self.arrays["ids"][k])))
        return out


def _under(seeds: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` words lie under seeds of n words that begin at the given places."""
    edge = np.zeros(size + n + 1, np.int64)
    np.add.at(edge, seeds, 1)
    np.add.at(edge, seeds + n, -1)
    return np.cumsum(edge)[:size] > 0


class Blocks:
    """Blocks on a worker: one given as arrays, or many as files that are mapped when they are needed."""

    def __init__(self, data: dict[int, bytes] | Pieces):
        self.data, self.open = data, {}
        self.numbers = sorted(data.numbers if isinstance(data, Pieces) else data)

    def __getstate__(self):
        return {**self.__dict__, "open": {}}

    def hits(self, texts: list[str | None], coverage: float) -> list[list[tuple[float, int]]]:
        hashes, _, _, first = words([plain(t) for t in texts], lower=False, inner=INNER)
        out: list[list[tuple[float, int]]] = [[] for _ in texts]
        for k in self.numbers:
            if k not in self.open:
                self.open[k] = Block(unpack(self.data.open(k) if isinstance(self.data, Pieces) else self.data[k]))
            for own, more in zip(out, self.open[k].hits(hashes, first, coverage)):
                own += more
        return out


def _packed(rows: list[tuple], min_match: int) -> bytes:
    items = sorted([(r[0], r[1]) for r in rows if r[0] is not None and r[1]], key=lambda r: (r[0], r[1]))
    return pack(Block.of(items, min_match).arrays)


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, min_match: int, block_bytes: int) -> Blocks:
    """The benchmark in blocks of about block_bytes."""
    whole_numbers(benchmark, item_col)
    item, text = F.col(f"`{item_col}`"), F.col(f"`{item_text_col}`")
    items = benchmark.select(item.cast("long").alias("item"), text.alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    if count == 1:
        return Blocks({0: _packed(items.collect(), min_match)})  # at most block_bytes
    parted = items.withColumn("piece", F.pmod(F.xxhash64("item", "text"), F.lit(count)).cast("int"))

    def build(folder: str | None) -> DataFrame:
        def put(pdf: pd.DataFrame) -> pd.DataFrame:
            number, data = int(pdf.piece.iloc[0]), _packed(list(zip(pdf.item.tolist(), pdf.text.tolist())), min_match)
            if folder:
                put_file(folder, str(number), data)
            return pd.DataFrame({"piece": [number], "data": [None if folder else data]})

        return parted.groupBy("piece").applyInPandas(put, "piece int, data binary")

    return Blocks(pieces(benchmark.sparkSession, build))


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, carry: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: contaminated, n_items, item_ids (ascending), best_item and best_coverage.

    An item counts if tiles of at least min_match words, or the whole item if it
    is shorter, cover the given share of its words. The best item has the
    greatest coverage, at a tie the least id; without any, best_item is null and
    best_coverage 0. Null texts hold nothing; items with a null id, a null text
    or no word are never found; of repeated items each id counts once. Repeated
    rows get equal answers; empty tables are fine. Item ids are integers (others are a TypeError).
    """
    marks = T.StructType([T.StructField("_item_hits", T.ArrayType(T.StructType([T.StructField("c", T.DoubleType()), T.StructField("i", T.LongType())])))])
    shared = df.sparkSession.sparkContext.broadcast(_blocks(benchmark, item_col, item_text_col, min_match, block_bytes))

    def run(batch: pa.RecordBatch) -> dict:
        found = shared.value.hits(batch.column(text_col).to_pylist(), coverage)
        return {"_item_hits": [[{"c": c, "i": i} for c, i in own] for own in found]}

    df = map_texts(df if carry else df.select(f"`{id_col}`", f"`{text_col}`"), [id_col, text_col], marks, run, text_col, carry=True)
    hits = F.col("_item_hits")
    best = F.try_element_at(F.array_sort(F.transform(hits, lambda h: F.struct((-h["c"]).alias("c"), h["i"].alias("i")))), F.lit(1))
    new = {"item_ids": F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["i"]))), "best_item": best["i"], "best_coverage": F.round(F.coalesce(-best["c"], F.lit(0.0)), 6)}
    made = ("contaminated", "n_items", *new)
    kept = [c for c in df.columns if c != "_item_hits" and c.lower() not in made and (carry or c == id_col)]
    df = df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(n) for n, c in new.items()])
    return df.select(*[F.col(f"`{c}`") for c in kept], (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), *new)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
