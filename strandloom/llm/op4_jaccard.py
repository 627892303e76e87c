"""Joining documents whose sets of word n-grams are alike, with adaptive multi-match prefixes.

Equal sets are one class, known by a signature of 128 bits; everything below is
about classes. Shingles are ordered by their frequency over all classes, the
rare ones first. Two sets that reach the threshold share at least l shingles
within the first n - overlap + l of each, or all of their least overlap if l is
more. Each document takes the l for which its candidates cost least, as
estimated from the frequencies of its prefix's shingles among other documents'
prefixes, which asks for correspondingly more shared shingles before a pair is
verified.

Only components are wanted, so shingles first link each class to the most
central class that they hold (a pair for each class and shingle, not for each
two classes); after that, pairs matter only between different components, and
all of those are searched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, documents, dropped, map_texts, written
from .textvec import mix, shingles, words

WORDS, PERCENT = 4, 85
#: Prefix lengthenings that a document can take.
LENGTHS = (1, 2, 4)
#: Cost of a verification, in postings.
VERIFY = 20
#: Shingles that a task gathers before it sends them out; classes of one block.
FLUSH, BLOCK = 1 << 19, 1024
#: Shingles that one range is meant to get: more of them make more ranges.
RANGE = 2 << 20
#: One in SAMPLE classes also says its shingles beforehand. Those that seem to stand in more than HOT classes are not
#: counted in one place: the estimate is their frequency. It only orders shingles, so that results don't hang on it.
SAMPLE, HOT = 64, 1 << 15
#: Signatures that a task remembers, so as to send the shingles of copies once.
SEEN = 1 << 17
#: Shingles of more postings than that carry parities of their classes' sets, of 4 bits a shingle or so, at least and at most these.
CROWD, BITS = 32, (1 << 8, 1 << 12)


def sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, ascending, and where they begin."""
    hashes, _, _, first = words([(t or "").encode("utf-8", "replace") for t in texts])
    found, at = shingles(hashes, first, n)
    of = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    found = found[new]
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(of[new], minlength=len(texts)), out=begin[1:])
    return found, begin


def signatures(found: np.ndarray, begin: np.ndarray, twice: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; both are 0 of the empty one.

    The first one names a class. Names in `twice` (sorted) are those of several
    classes: there, both hashes make the name. bits: of the first hash.
    """
    n = np.diff(begin).astype(np.uint64)
    both = []
    for salt in (np.uint64(0x51), np.uint64(0xA7)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found + salt), dtype=np.uint64)])
        both.append(np.where(n > 0, mix(sums[begin[1:]] - sums[begin[:-1]] + n * (salt | np.uint64(1))), np.uint64(0)))
    one, other = both[0] >> np.uint64(64 - bits), both[1]
    if len(twice):
        at = np.minimum(np.searchsorted(twice, one.view(np.int64)), len(twice) - 1)
        one = np.where((twice[at] == one.view(np.int64)) & (n > 0), mix(one + mix(other)), one)
    return one.view(np.int64), other.view(np.int64)


def overlap(n, m, percent: int):
    """The least overlap of sets of n and m shingles that reach the threshold."""
    return -(-(percent * (n + m)) // (percent + 100))


def least_overlap(n, percent: int):
    """The least overlap of a set of n with any set that reaches the threshold."""
    return overlap(n, -(-(percent * n) // 100), percent)


def _rows(df: DataFrame, id_col: str, text_col: str, n: int, twice: np.ndarray, bits: int) -> DataFrame:
    """(id, n, sig, other, some) of every row; some: the shingles of one class in SAMPLE."""
    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in ("n", "sig", "other")], T.StructField("some", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> dict:
        found, begin = sets(batch.column("text").to_pylist(), n)
        sig, other = signatures(found, begin, twice, bits)
        some = [found[a:b].tobytes() if o % SAMPLE == 0 else None for a, b, o in zip(begin, begin[1:], other.tolist())]
        return {"n": pa.array(np.diff(begin)), "sig": pa.array(sig), "other": pa.array(other), "some": pa.array(some, pa.binary())}

    return map_texts(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), ["id", "text"], schema, run, "text")


class _Classes:
    """The rows' sets, and what is known of the classes before their shingles are compared."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, n: int, bits: int = 64):
        #: Names of several classes, by chance or (with few bits) by design: some hundred among 1e11 classes.
        self.twice, self.bits = np.zeros(0, np.int64), bits
        for _ in range(3):
            self.rows = written(_rows(df, id_col, text_col, n, self.twice, bits))
            filled = self.rows.filter((F.col("n") > 0) & F.col("id").isNotNull())
            #: (sig, id): each class with its least id, and whether it is more than one.
            self.table = written(filled.groupBy("sig").agg(F.min("id").alias("id"), F.max("n").alias("n"), (F.min("other") < F.max("other")).alias("several")))
            more = np.array([r[0] for r in self.table.filter("several").select("sig").collect()], np.int64)
            if not len(more):
                break
            self.twice = np.union1d(self.twice, more)
        else:
            raise RuntimeError(f"sets that differ have equal signatures: {more[:5]}")
        spark = df.sparkSession
        total = self.table.agg(F.sum("n")).first()[0] or 0
        at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: Ranges are grouped one after the other; a task has about four where there are many.
        self.parts = max(at_least, -(-total // RANGE))
        self.tasks = max(at_least, -(-self.parts // 4))
        said = self.rows.filter(F.col("some").isNotNull() & (F.col("n") > 0)).select("sig", "some").dropDuplicates(["sig"])

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(some, np.int64))], names=["token"])

        often = said.select("some").mapInArrow(tokens, "token long").groupBy("token").count().filter(F.col("count") * SAMPLE > HOT)
        # At most total / HOT tokens; the hottest 2**18 of them are set apart.
        hot = sorted((r[0], r[1] * SAMPLE) for r in often.orderBy(F.desc("count"), "token").limit(1 << 18).collect())
        self.hot = np.array([t for t, _ in hot], np.int64).view(np.uint64), np.array([c for _, c in hot], np.uint32)
        order = np.argsort(self.hot[0])
        self.hot = self.hot[0][order], self.hot[1][order]


def _hot(found: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles are hot, and their estimated frequency."""
    if not len(hot[0]):
        return np.zeros(len(found), bool), np.zeros(len(found), np.uint32)
    at = np.minimum(np.searchsorted(hot[0], found), len(hot[0]) - 1)
    return hot[0][at] == found, hot[1][at]


def _sent(df: DataFrame, text_col: str, n: int, classes: _Classes) -> DataFrame:
    """Shingles dealt out over ranges, hot ones by their class: for each range, lists of classes (signature, size, how many follow) and their shingles."""
    schema = "part int, sigs binary, sizes binary, counts binary, keys binary"
    parts, twice, bits = classes.parts, classes.twice, classes.bits
    shared = df.sparkSession.sparkContext.broadcast(classes.hot)

    def send(chunk: list[tuple]) -> pa.RecordBatch:
        found = np.concatenate([c[0] for c in chunk])
        size = np.concatenate([c[1] for c in chunk])
        sig = np.concatenate([c[2] for c in chunk])
        of = np.repeat(np.arange(len(size)), size)
        spread = np.where(_hot(found, shared.value)[0], mix(sig.view(np.uint64))[of], mix(found))
        part = (spread % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        found, of, part = found[order], of[order], part[order]
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        rows = []
        for a, b in zip(edges, [*edges[1:], len(part)]):
            first = np.flatnonzero(np.diff(of[a:b], prepend=-1))
            own = of[a:b][first]
            rows.append((int(part[a]), sig[own].tobytes(), size[own].astype(np.uint32).tobytes(), np.diff(first, append=b - a).astype(np.uint32).tobytes(), found[a:b].tobytes()))
        columns = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["part", "sigs", "sizes", "counts", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, seen = [], 0, set()
        for batch in batches:
            texts, size, at = batch.column(0).to_pylist(), 0, 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size > SLICE_BYTES or k + 1 == len(texts):
                    found, begin = sets(texts[at : k + 1], n)
                    sig, count = signatures(found, begin, twice, bits)[0], np.diff(begin)
                    new = np.zeros(len(sig), bool)
                    new[np.unique(sig, return_index=True)[1]] = True
                    new &= np.array([s not in seen for s in sig.tolist()], bool) & (count > 0)
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.update(sig[new].tolist())
                    chunk.append((found[np.repeat(new, count)], count[new], sig[new]))
                    held += int(count[new].sum())
                    size, at = 0, k + 1
                if held > FLUSH:
                    yield send(chunk)
                    chunk, held = [], 0
        if held:
            yield send(chunk)

    return df.select(F.col(f"`{text_col}`")).mapInArrow(run, schema)


def _bytes(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _shared(sent: DataFrame, classes: _Classes) -> DataFrame:
    """Of each range the shingles that at least two classes hold, with that number, dealt out by class."""
    schema = "bucket int, sigs binary, sizes binary, counts binary, keys binary, df binary"
    parts = classes.parts
    shared = sent.sparkSession.sparkContext.broadcast(classes.hot)

    def count(table: pa.Table) -> pa.Table:
        sig, size, held, key = _bytes(table, "sigs", np.int64), _bytes(table, "sizes", np.uint32), _bytes(table, "counts", np.uint32), _bytes(table, "keys", np.uint64)
        once = np.zeros(len(sig), bool)
        once[np.unique(sig, return_index=True)[1]] = True  # a class counts once, however many copies it has
        key, of = key[np.repeat(once, held)], np.repeat(np.arange(len(sig)), np.where(once, held, 0))
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.diff(key[order], prepend=key[order][:1] + np.uint64(1)) != 0)
        df = np.empty(len(key), np.uint32)
        df[order] = np.repeat(np.diff(start, append=len(key)), np.diff(start, append=len(key)))
        hot, estimate = _hot(key, shared.value)
        df = np.where(hot, estimate, df)
        key, of, df = key[df > 1], of[df > 1], df[df > 1]
        bucket = (mix(sig.view(np.uint64)) % np.uint64(parts)).astype(np.int64)[of]
        order = np.argsort(bucket, kind="stable")
        key, of, df, bucket = key[order], of[order], df[order], bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = []
        for a, b in zip(edges, [*edges[1:], len(bucket)]):
            first = np.flatnonzero(np.diff(of[a:b], prepend=-1))
            own = of[a:b][first]
            rows.append((int(bucket[a]), sig[own].tobytes(), size[own].tobytes(), np.diff(first, append=b - a).astype(np.uint32).tobytes(), key[a:b].tobytes(), df[a:b].tobytes()))
        columns = list(zip(*rows)) or [[]] * 6
        return pa.table([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["bucket", "sigs", "sizes", "counts", "keys", "df"])

    return sent.repartition(classes.tasks, "part").groupBy("part").applyInArrow(count, schema)


def parities(tokens: np.ndarray) -> bytes:
    """How many of the tokens fall on each bit, modulo 2. Common ones cancel out: two sets differ in as many tokens as in bits, at least."""
    bits = min(max(BITS[0], 1 << int(4 * len(tokens) - 1).bit_length()), BITS[1])
    at = (mix(tokens.view(np.uint64) + np.uint64(0x33)) % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) % 2 == 1).tobytes()


def differing(bits: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the parities of sets x and y differ; the longer ones are folded. None told where there are none."""
    out = np.zeros(len(x), np.int64)
    width = np.array([len(b) if b is not None else 0 for b in bits], np.int64)
    both = np.minimum(width[x], width[y])
    for w in np.unique(both[both > 0]).tolist():
        rows = np.flatnonzero(width >= w)
        place = np.zeros(len(bits), np.int64)
        place[rows] = np.arange(len(rows))
        table = np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, w // 8), axis=0) for b in bits[rows]])
        those, step = np.flatnonzero(both == w), max(1, (1 << 22) // w)
        for a in range(0, len(those), step):
            k = those[a : a + step]
            out[k] = np.bitwise_count(table[place[x[k]]] ^ table[place[y[k]]]).sum(1, dtype=np.int64)
    return out


def _entries(shared: DataFrame, classes: _Classes, percent: int) -> DataFrame:
    """Classes that can reach the threshold with any other: size n, shared shingles from rare to frequent, how many of their own (alone) come before, and the shared ones' parities."""
    schema = "sig long, n long, alone long, tokens array<long>, bits binary"

    def gather(table: pa.Table) -> pa.Table:
        sig, size, held = _bytes(table, "sigs", np.int64), _bytes(table, "sizes", np.uint32), _bytes(table, "counts", np.uint32)
        token, df = _bytes(table, "keys", np.int64), _bytes(table, "df", np.uint32)
        owner = np.repeat(sig, held)
        order = np.lexsort((token, df, owner))
        token, owner = token[order], owner[order]
        first = np.flatnonzero(np.diff(owner, prepend=owner[:1] ^ 1) != 0)
        count = np.diff(first, append=len(owner))
        sizes = dict(zip(sig.tolist(), size.tolist()))
        n = np.array([sizes[s] for s in owner[first].tolist()], np.int64)
        can = count >= least_overlap(n, percent)
        tokens = [token[a : a + c] for a, c in zip(first[can], count[can])]
        return pa.table([pa.array(owner[first[can]]), pa.array(n[can]), pa.array((n - count)[can]), pa.array(tokens, pa.list_(pa.int64())), pa.array([parities(x) for x in tokens], pa.binary())], names=["sig", "n", "alone", "tokens", "bits"])

    return shared.repartition(classes.tasks, "bucket").groupBy("bucket").applyInArrow(gather, schema)


def _postings(entries: DataFrame, percent: int, length: int) -> DataFrame:
    """(token, sig, n, pos, from, near) of each class's prefix for a lengthening.

    from: the least one whose prefix has the token; near: the same of the shorter
    prefix that is enough against sets of the same size.
    """
    n = F.col("n")
    least = _ceil_div(percent * (n + _ceil_div(percent * n, 100)), percent + 100)
    own = entries.select("sig", "n", "alone", least.alias("least"), F.posexplode(F.slice("tokens", 1, (n - least + length - F.col("alone")).cast("int"))))
    pos = F.col("alone") + F.col("pos")
    return own.select(F.col("col").alias("token"), "sig", "n", pos.alias("pos"), (pos - F.col("n") + F.col("least") + 1).alias("from"), (pos - F.col("n") + _ceil_div(2 * percent * F.col("n"), percent + 100) + 1).alias("near"))


def _ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("long")


def _verified(pairs: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose sets reach the threshold. Shared shingles are all among the entries' tokens.

    Each join has shuffled rows on both sides, so that a class that stands in
    very many pairs is split by the adaptive plan.
    """
    left = entries.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = entries.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    both = both.withColumn("common", F.size(F.array_intersect("ta", "tb")))
    return both.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def components(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(sig, label) of every linked class: the least (id, sig) that it reaches. ids: (sig, id) of each class.

    Each round takes the least label among neighbours and then that label's own
    label, so that chains shorten by half; it ends when no label changes.
    """
    own = lambda name: ids.select(F.col("sig").alias(name), F.struct("id", "sig").alias(f"own_{name}"))
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    table = written(both.join(own("a"), "a").join(own("b"), "b"))
    before = written(table.groupBy(F.col("a").alias("sig")).agg(F.least(F.min("own_b"), F.min("own_a")).alias("label")))
    labels, edges = before, table.select("a", "b")
    while True:
        near = edges.join(labels.withColumnRenamed("sig", "b"), "b").groupBy(F.col("a").alias("sig")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "sig").select("sig", "label", F.least("label", "near").alias("low")).withColumn("at", F.col("low.sig"))
        jump = labels.select(F.col("sig").alias("at"), F.col("label").alias("lower"))
        moved = written(lower.join(jump, "at", "left").select("sig", F.col("label").alias("old"), F.least("low", F.coalesce("lower", "low")).alias("label")))
        dropped(before)
        before, labels = moved, moved.select("sig", "label")
        if moved.filter(F.col("old.sig") != F.col("label.sig")).isEmpty():
            dropped(table)
            return labels


class _Pairs:
    """Pairs of one shingle's classes in different components that may reach the threshold."""

    def __init__(self, percent: int):
        self.percent = percent

    def masks(self, g: dict[str, np.ndarray]):
        """For rows of up to 256 classes: which of the classes before each in the group are its candidates."""
        size = len(g["n"])
        for a in range(0, size, 256):
            rows = slice(a, min(a + 256, size))
            n, m = g["n"][rows, None], g["n"][None, :]
            able = (g["label"][rows, None] != g["label"][None, :]) & (np.minimum(n, m) * 100 >= self.percent * np.maximum(n, m))
            able &= np.arange(size)[None, :] < np.arange(rows.start, rows.stop)[:, None]
            able &= (g["one"][0] == g["other"][0]) | (g["block"][rows, None] != g["block"][None, :])
            least = overlap(n, m, self.percent)
            own, theirs = g["pos"][rows, None] - n + least, g["pos"][None, :] - m + least
            length = np.minimum(g["length"][rows, None], g["length"][None, :])
            yield rows, able & (own < length) & (theirs < length)

    def groups(self, batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        """Rows of the same shingle and blocks stand together; a group is at most two blocks."""
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            now = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
            if held is not None:
                now = {k: np.concatenate([held[k], now[k]]) for k in now}
            if not len(now["n"]):
                continue
            edge = np.flatnonzero((np.diff(now["token"]) != 0) | (np.diff(now["one"]) != 0) | (np.diff(now["other"]) != 0)) + 1
            edges = [0, *edge.tolist()]
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    yield {k: v[a:b] for k, v in now.items()}
            held = {k: v[edges[-1] :] for k, v in now.items()}
        if held is not None and len(held["n"]) > 1:
            yield held

    def pairs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in self.groups(batches):
            length = g["length"]
            for rows, mask in self.masks(g):
                x, y = np.nonzero(mask)
                x = x + rows.start
                if len(x) and "bits" in g:
                    # Shared shingles are half of what both sets hold and don't differ in.
                    may = 2 * overlap(g["n"][x], g["n"][y], self.percent) + differing(g["bits"], x, y) <= g["shared"][x] + g["shared"][y]
                    x, y = x[may], y[may]
                if len(x):
                    s, t = g["sig"][x], g["sig"][y]
                    need = np.minimum(np.minimum(length[x], length[y]), overlap(g["n"][x], g["n"][y], self.percent))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(s, t)), pa.array(np.maximum(s, t)), pa.array(need)], names=["a", "b", "need"])


def _lengthened(entries: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """(token, sig, label, n, length, pos, shared, bits): every class's prefix for the lengthening that costs it least, without shingles that one component alone has.

    A prefix's cost is estimated from how many classes of other components have
    its shingles in theirs, all taken as of the same size: that many postings are
    met, and a candidate has to be met `length` times to be verified.
    """
    marked = _postings(entries, percent, LENGTHS[-1])
    if labels is None:
        marked = marked.withColumn("label", F.col("sig"))
    else:
        marked = marked.join(labels.select("sig", F.col("label.sig").alias("label")), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    held = marked.groupBy("token", "label").agg(*[F.count(F.when(F.col("near") <= k, 1)).alias(f"c{k}") for k in LENGTHS], F.count("*").alias("held"))
    sums = held.groupBy("token").agg(*[F.sum(f"c{k}").alias(f"t{k}") for k in LENGTHS], F.sum("held").alias("all"))
    others = held.join(sums, "token").filter(F.col("held") < F.col("all"))
    others = written(others.select("token", "label", *[(F.col(f"t{k}") - F.col(f"c{k}")).alias(f"o{k}") for k in LENGTHS]))
    across = written(marked.join(others, ["token", "label"]))
    cost = lambda k: F.sum(F.when(F.col("near") <= k, F.col(f"o{k}")).otherwise(0)) * (1 + VERIFY / k)
    cheapest = F.array_min(F.array(*[F.struct(cost(k).alias("cost"), F.lit(k).cast("long").alias("length")) for k in LENGTHS]))["length"]
    chosen = across.join(across.groupBy("sig").agg(cheapest.alias("length")), "sig").filter(F.col("from") <= F.col("length"))
    more = entries.select("sig", F.size("tokens").cast("long").alias("shared"), "bits")
    return chosen.join(more, "sig").select("token", "sig", "label", "n", "length", "pos", "shared", "bits")


def _cells(postings: DataFrame, percent: int) -> DataFrame:
    """The postings, each with the cells in which it meets others of its shingle.

    A shingle of up to BLOCK classes is one cell. More of them are dealt out by
    bands of their size, since only neighbouring bands can reach the threshold,
    and each band's in blocks: every two blocks of such bands meet in one cell.
    Only crowded shingles keep the parities: elsewhere a posting meets few others.
    """
    # A little wider than the threshold, so that rounding can't put classes that reach it two bands apart.
    marked = written(postings.withColumn("band", F.floor(F.log(F.col("n")) / math.log(100 / percent * 1.001)).cast("int")))
    sizes = marked.groupBy("token", "band").agg(F.count("*").alias("size"), F.min("label").alias("least"), F.max("label").alias("most"))
    blocks = F.struct("band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    several = sizes.groupBy("token").agg(F.sum("size").alias("size"), F.min("least").alias("least"), F.max("most").alias("most"), F.collect_list(blocks).alias("bands")).filter("size > 1 AND least <> most")
    bands = written(several.select("token", F.when(F.col("size") > BLOCK, F.map_from_entries("bands")).alias("bands"), (F.col("size") > CROWD).alias("crowded")))
    rows = marked.join(bands, "token").withColumn("bits", F.when(F.col("crowded"), F.col("bits")))
    code = lambda band, block: band.cast("long") * (1 << 32) + block
    home = F.when(F.col("bands").isNull(), F.lit(0).cast("long")).otherwise(code(F.col("band"), F.pmod(F.xxhash64("sig"), F.element_at("bands", F.col("band")))))
    others = F.flatten(F.transform(F.array(*[F.col("band") + d for d in (-1, 0, 1)]), lambda b: F.transform(F.sequence(F.lit(1), F.greatest(F.coalesce(F.try_element_at("bands", b), F.lit(0)), F.lit(1))), lambda j: F.when(F.try_element_at("bands", b).isNotNull(), code(b, j - 1)))))
    met = F.when(F.col("bands").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array_compact(others))
    rows = rows.withColumn("block", home).withColumn("met", F.explode(met))
    return rows.select("token", "sig", "label", "n", "length", "pos", "block", F.least("block", "met").alias("one"), F.greatest("block", "met").alias("other"), "shared", "bits")


def _search(entries: DataFrame, labels: DataFrame | None, percent: int, tasks: int) -> DataFrame:
    """All (a, b) of classes with different labels that reach the threshold; classes without a label have their own."""
    cells = _cells(_lengthened(entries, labels, percent), percent)
    dealt = cells.repartition(tasks, "token", "one", "other").sortWithinPartitions("token", "one", "other")
    found = dealt.mapInArrow(_Pairs(percent).pairs, "a long, b long, need long")
    pairs = found.groupBy("a", "b").agg(F.count("*").alias("common"), F.first("need").alias("need")).filter("common >= need")
    return _verified(pairs, entries, percent)


def _compared(df: DataFrame, id_col: str, text_col: str, n: int, percent: int, bits: int) -> tuple[_Classes, DataFrame]:
    """The classes, and those of them that share enough shingles with others."""
    classes = _Classes(df, id_col, text_col, n, bits)
    with_id = df.filter(F.col(f"`{id_col}`").isNotNull())
    return classes, written(_entries(_shared(_sent(with_id, text_col, n, classes), classes), classes, percent))


def links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The join itself, as (members, pairs): each row's id and class, and the two classes of each link, once.

    Rows link if they are of the same class or if their classes are a pair, by
    the rule of link_components. Rows that link with nothing by it, with a null
    id or without words, are in no class.
    """
    classes, entries = _compared(df, id_col, text_col, n, percent, 64)
    members = classes.rows.filter((F.col("n") > 0) & F.col("id").isNotNull()).select(F.col("id").alias(id_col), F.col("sig").alias("class"))
    return members, _search(entries, None, percent, classes.tasks)


def link_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT, signature_bits: int = 64, hubs: int = 1) -> DataFrame:
    """Per row n_shingles and component_id: the least id that it reaches over links.

    Rows link when 100 * intersection >= percent * union of their sets of
    distinct n-word shingles (A-Z in lower case, words between ASCII white
    space; a text of fewer words has its whole sequence as its one shingle). A
    null text, or one without words, links with nothing. So does a row with a
    null id, whose component_id is null. Repeated rows link like other equal
    texts; an empty table stays empty. Fewer signature_bits only make more
    signatures that stand for several classes, which are then told apart.
    More hubs make a dearer first pass, and leave fewer pairs to the search where copies differ much.
    """
    classes, entries = _compared(df, id_col, text_col, n, percent, signature_bits)
    ids = classes.table.select("sig", "id")

    # Each class with the class for which one of its prefix's shingles comes earliest.
    first = _postings(entries, percent, LENGTHS[0])
    # With several hubs the others are drawn by rank, so that shingles of one group of copies mostly draw the same class:
    # copies that are unlike the most central class meet others, and few of them. What they don't link is left to the search.
    drawn = [F.min(F.struct(F.xxhash64("sig", F.lit(j)), "pos", "sig", "n")) for j in range(1, hubs)]
    own = [F.min(F.struct(F.lit(0).cast("long"), "pos", "sig", "n")), *drawn]
    own = F.array(*[F.struct(x["pos"].alias("pos"), x["sig"].alias("sig"), x["n"].alias("n")) for x in own])
    hubs = first.groupBy("token").agg(F.count("*").alias("held"), own.alias("hubs")).filter("held > 1").select("token", F.explode(F.array_distinct("hubs")).alias("hub")).select("token", "hub.*")
    hubs = written(hubs.select("token", F.col("sig").alias("hub"), F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos")))
    least = _ceil_div(percent * (F.col("n") + F.col("hub_n")), percent + 100)
    stars = (
        first.join(hubs, "token")
        .filter((F.col("sig") != F.col("hub")) & (F.least("n", "hub_n") * 100 >= percent * F.greatest("n", "hub_n")))
        .filter((F.col("pos") <= F.col("n") - least) & (F.col("hub_pos") <= F.col("hub_n") - least))
        .select(F.col("sig").alias("a"), F.col("hub").alias("b"))
        .distinct()
    )
    linked = written(_verified(stars, entries, percent))
    labels = components(linked, ids)

    # All pairs of different components.
    more = written(_search(entries, labels, percent, classes.tasks))
    if not more.isEmpty():
        labels = components(linked.union(more), ids)

    reached = written(ids.join(labels, "sig", "left").select("sig", F.coalesce("label.id", "id").alias("component_id")))
    in_class = (F.col("n") > 0) & F.col("id").isNotNull()
    alone = classes.rows.filter(~in_class).select("id", "n", F.col("id").alias("component_id"))
    out = classes.rows.filter(in_class).select("id", "n", "sig").join(reached, "sig").select("id", "n", "component_id").union(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(documents(spark, sf_dir))


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(
    CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, e.y FROM reach JOIN e ON e.x = reach.r)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.r) AS component_id
FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
