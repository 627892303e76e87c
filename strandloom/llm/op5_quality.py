"""A text quality score by a factorisation machine.

Inputs are hashed words (by the root of their frequency), statistics of the
text's structure, and metadata. Each input has a weight and a short vector; the
score adds the weights and all pairs' vector products. By the sum-of-squares
identity the pairs cost no more than the inputs: half of the squared sum less
the summed squares, for each of the vectors' places.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, map_texts
from .op2_language import fold
from .textvec import joined, words

BITS, RANK = 12, 8
#: Labelled rows of each class at most.
PER_CLASS = 2000
EPOCHS, RATE, DECAY, BLOCK = 40, 0.02, 1e-5, 1024
THRESHOLD = 0.3
#: Shares of bytes of these kinds, from the text's structure.
KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?", b".,;:", b"|\t", b"%&*#$@=<>{}[]\\/~^_+", b"\"'()-", b" ", b"\n\r", bytes(range(128, 256)))
STATISTICS = len(KINDS) + 9
WIDTH = (1 << BITS) + STATISTICS


def _kind_table() -> np.ndarray:
    table = np.full(256, len(KINDS), np.uint8)
    for k, kind in enumerate(KINDS):
        table[list(kind)] = k
    return table


KIND = _kind_table()


def features(texts: list[str | None], chars: list[int | None]) -> np.ndarray:
    """One row of inputs for each text; at most BLOCK texts at a time. Null counts as empty."""
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    n = len(data)
    hashes, start, end, first = words(data)
    count = np.diff(first)
    row = np.repeat(np.arange(n), count)
    out = np.zeros((n, WIDTH), np.float32)
    tally = np.bincount(row * (1 << BITS) + (hashes >> np.uint64(64 - BITS)).astype(np.int64), minlength=n << BITS).reshape(n, 1 << BITS)
    out[:, : 1 << BITS] = np.sqrt(tally / np.maximum(count, 1)[:, None])
    raw, at = joined(data)
    size = np.diff(at)
    kinds = np.bincount(np.repeat(np.arange(n), size) * 16 + KIND[raw], minlength=n * 16).reshape(n, 16).astype(np.float64)
    kinds[:, KINDS.index(b" ")] -= 1  # joined() puts a space behind each text
    s = out[:, 1 << BITS :]
    s[:, : len(KINDS)] = kinds[:, : len(KINDS)] / np.maximum(size - 1, 1)[:, None]
    total, k = np.maximum(count, 1), len(KINDS)
    again = np.zeros(len(hashes))
    if len(hashes) > 1:
        again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    s[:, k] = np.bincount(row, again, n) / total
    s[:, k + 1] = (tally > 0).sum(1) / np.minimum(total, 1 << BITS)
    s[:, k + 2] = np.bincount(row, end - start, n) / total / 20
    s[:, k + 3] = np.bincount(row, (end - start) > 15, n) / total
    s[:, k + 4] = np.log1p(count) / 10
    s[:, k + 5] = np.log1p(kinds[:, KINDS.index(b"\n\r")]) / 10
    s[:, k + 6] = count == 0
    s[:, k + 7] = [np.log1p(max(c, 0)) / 12 if c is not None else 0 for c in chars]
    s[:, k + 8] = [c is None for c in chars]
    return out


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        summed = x @ self.vectors
        return self.bias + x @ self.weights + 0.5 * ((summed**2).sum(1) - (x**2 @ self.vectors**2).sum(1))

    def scores(self, texts: list[str | None], chars: list[int | None]) -> list[float]:
        out: list[float] = []
        for a in range(0, len(texts), BLOCK):
            x = features(texts[a : a + BLOCK], chars[a : a + BLOCK])
            out += np.round(1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30).astype(np.float64))), 6).tolist()
        return out


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Machine:
    """Adam on the weighted logistic loss."""
    rng = np.random.default_rng(11)
    rate = float(np.clip((y * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    model = Machine(float(np.log(rate / (1 - rate))), np.zeros(x.shape[1], np.float32), rng.normal(0, 0.02, (x.shape[1], RANK)).astype(np.float32))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (np.zeros(1, np.float32), model.weights, model.vectors)]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(y), 256):
            own = order[a : a + 256]
            batch = x[own]
            summed = batch @ model.vectors
            margin = np.clip(model.margin(batch), -30, 30)
            g = ((1 / (1 + np.exp(-margin)) - y[own]) * weight[own] / len(own)).astype(np.float32)
            grads = (g.sum(keepdims=True), batch.T @ g + DECAY * model.weights, batch.T @ (g[:, None] * summed) - (batch**2).T @ g[:, None] * model.vectors + DECAY * model.vectors)
            step += 1
            for p, (grad, (m, v)) in enumerate(zip(grads, state)):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                change = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                if p == 0:
                    model.bias -= float(change[0])
                elif p == 1:
                    model.weights -= change
                else:
                    model.vectors -= change
    return model


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chars_col: str = "n_chars", per_class: int = PER_CLASS) -> Machine | None:
    """A machine from at most per_class labelled rows of each class, chosen by a hash of their ids and weighted back to the classes' shares.

    Only labels 0 and 1 count. Of labels that repeat an id the least counts, of
    rows that repeat it the one whose text has the least hash. None if no
    labelled row of `labels` has a row in `df`.
    """
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit("sample")), F.lit(1 << 20))
    labels = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    labels = labels.groupBy("id").agg(F.min("label").alias("label"))
    counts = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, 1.2 * per_class / n))).otherwise(share)
    # Bounded: about per_class rows of each class, and never more than twice that.
    chosen = labels.filter(draw < share * (1 << 20)).limit(4 * per_class)
    schema = T.StructType([T.StructField("at", T.BinaryType()), T.StructField("value", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> dict:
        texts, chars = batch.column("text").to_pylist(), batch.column("chars").to_pylist()
        x = np.concatenate([features(texts[a : a + BLOCK], chars[a : a + BLOCK]) for a in range(0, len(texts), BLOCK)])
        at = [np.flatnonzero(r) for r in x]
        return {"at": [i.astype(np.uint16).tobytes() for i in at], "value": [r[i].tobytes() for r, i in zip(x, at)]}

    own = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{chars_col}`").alias("chars"))
    sampled = own.join(F.broadcast(chosen), "id").withColumn("draw", draw).withColumn("hash", F.xxhash64("text"))
    made = map_texts(sampled, ["id", "text", "chars"], schema, run, "text", carry=True)
    rows = made.groupBy("id", "label", "draw").agg(F.min(F.struct("hash", "at", "value")).alias("x")).select("label", "draw", "x.at", "x.value").collect()
    rows.sort(key=lambda r: (r[0], r[1], bytes(r[3])))
    rows = [r for _, own in itertools.groupby(rows, key=lambda r: r[0]) for r in itertools.islice(own, per_class)]
    if not rows:
        return None
    x = np.zeros((len(rows), WIDTH), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["value"], np.float32)
    y = np.array([r[0] for r in rows], np.float32)
    used = np.bincount(y.astype(int), minlength=2)
    weight = np.array([counts[int(c)] / used[int(c)] for c in y])
    return train(x, y, (weight / weight.mean()).astype(np.float32))


def score(df: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """score (0 to 1) and predicted (1 if score >= threshold) for every row.

    A null text counts as an empty one and is scored like any other; a null
    number of characters has an input of its own. Without a machine (nothing
    was learned) every score is 0.5. Repeated rows get equal scores; an empty
    table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(machine)
    schema = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(text_col).to_pylist()
        made = shared.value.scores(texts, batch.column(chars_col).to_pylist()) if shared.value else [0.5] * len(texts)
        return {"score": made, "predicted": [int(s >= threshold) for s in made]}

    return map_texts(df, [id_col, text_col, chars_col], schema, run, text_col, carry)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = fit(docs, labels.filter(fold("doc_id", 5) != 0))
    return score(docs, machine).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
