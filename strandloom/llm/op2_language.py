"""Language identification in two steps: the family, then the language within it.

Linear support vector machines over frequencies of byte bigrams and trigrams of
the lower-cased letters. Families are told apart one versus one, and so are the
languages of each family; margins become probabilities by a fitted logistic
curve. Fitting uses a bounded sample of labelled rows; scoring is a sum of
table entries over the whole text, for the machines between families and for
those of the family that wins.

The machines only compare learned languages, and so their score tells nothing
of a text in none of them. For that each language has a profile, the log
frequencies of its n-grams: a text is as typical as its mean entry, on a scale
where 0 is what n-grams drawn at random have and 1 is the median of rows that
were held out of the profile.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, map_texts

#: Families by ISO 639-1 code. A language that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu", "ne"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
ORDERS, BITS = (2, 3), 12
#: Training rows of each language at most, and of all together at most (but LEAST_ROWS of each language).
PER_LANGUAGE, ALL_ROWS, LEAST_ROWS = 800, 24_000, 8
SCALE, PENALTY, ROUNDS = 30.0, 10.0, 60
#: Added to the frequencies of a profile, for n-grams it has not seen.
UNSEEN = 1e-5
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")


def _table() -> np.ndarray:
    """a-z and bytes from 128 on stay; all others become spaces."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


LETTERS = _table()


def ngrams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the hashed n-grams at every byte; where each text begins and ends."""
    raw = [b" " + t.lower().encode("utf-8", "replace") + b"   " for t in texts]
    data = LETTERS[np.frombuffer(b"".join(raw), np.uint8)].astype(np.uint32)
    sizes = np.array([len(r) for r in raw], np.int64)
    end = np.cumsum(sizes)
    out, padded = [], np.concatenate([data, np.full(4, 32, np.uint32)])
    for k, n in enumerate(ORDERS):
        code = np.zeros(len(data), np.uint32)
        for j in range(n):
            code = code * np.uint32(256) + padded[j : j + len(data)]
        out.append(((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)) + np.uint32(k << BITS))
    return out, end - sizes, end - 2


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The frequencies of each text's n-grams: (numbers, values)."""
    codes, start, end = ngrams(texts)
    out = []
    for a, b in zip(start, end):
        counts = np.bincount(np.concatenate([c[a:b] for c in codes]), minlength=len(ORDERS) << BITS)
        at = np.flatnonzero(counts)
        out.append((at.astype(np.uint16), (counts[at] * (SCALE / (b - a))).astype(np.float32)))
    return out


Row = tuple[np.ndarray, np.ndarray]


def fit_svm(x: list[Row], rows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Dual coordinate descent for a linear support vector machine (hinge loss) on some rows; then a logistic curve over the margins.

    Both classes weigh the same. Returns weights, the bias, and the curve's slope.
    """
    cost = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * PENALTY
    norm = np.array([float(x[r][1] @ x[r][1]) for r in rows]) + 1
    alpha, w, bias, order = np.zeros(len(y)), np.zeros(len(ORDERS) << BITS, np.float32), 0.0, np.random.default_rng(7)
    for _ in range(ROUNDS):
        moved = 0.0
        for i in order.permutation(len(y)):
            at, own = x[rows[i]]
            gradient = y[i] * (float(own @ w[at]) + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if change := new - alpha[i]:
                w[at] += np.float32(change * y[i]) * own
                bias += change * y[i]
                moved = max(moved, abs(change))
                alpha[i] = new
        if moved < 1e-3:
            break
    margins = np.array([float(x[r][1] @ w[x[r][0]]) for r in rows]) + bias
    margin, slope = y * margins, 1.0
    for _ in range(30):  # Newton's method for the slope, lightly held to 3
        p = 1 / (1 + np.exp(np.clip(slope * margin, -500, 500)))
        step = (margin @ p - (slope - 3)) / ((margin**2) @ (p * (1 - p)) + 1)
        slope = max(slope + np.clip(step, -2, 2), 0.1)
    return w, float(bias), float(slope)


@dataclass
class Choice:
    """One versus one machines between some classes."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    columns: list[int] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)
    slope: list[float] = field(default_factory=list)

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """Each class's mean probability against the k - 1 others: 0 to 1, and at least 0.5 for the best."""
        n, k = len(sums), len(self.classes)
        if k == 1:
            return np.ones((n, 1))
        p = np.zeros((n, k))
        for (a, b), column, bias, slope in zip(self.pairs, self.columns, self.bias, self.slope):
            own = 1 / (1 + np.exp(np.clip(-slope * (sums[:, column] + bias), -500, 500)))
            p[:, a] += own
            p[:, b] += 1 - own
        return p / (k - 1)


@dataclass
class Model:
    weights: np.ndarray  # n-gram x machine
    families: Choice
    languages: dict[str, Choice]
    profiles: dict[str, int] = field(default_factory=dict)  # columns of weights

    def predict(self, texts: list[str | None], typical: bool = True) -> tuple[list[str], list[float], list[float]]:
        """The language and the probability of each text, and (if asked) how typical it is of that language: 1 without a profile."""
        names, scores, likeness = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        if not known:
            return names, scores, likeness
        codes, start, end = ngrams([texts[i] for i in known])
        scale = SCALE / (end - start)

        def sums(rows: np.ndarray, columns: list[int]) -> np.ndarray:
            """For some texts the machines' sums, without the biases."""
            whole, size = len(rows) == len(known), (end - start)[rows]
            begin = np.cumsum(size) - size
            at = None if whole else np.arange(size.sum()) + np.repeat(start[rows] - begin, size)
            edges = np.ravel(np.column_stack([start, end])) if whole else begin
            out = np.zeros((len(rows), self.weights.shape[1]))
            own_codes = codes if whole else [code[at] for code in codes]
            for m in columns:
                own = np.ascontiguousarray(self.weights[:, m])
                for code in own_codes:
                    out[:, m] += np.add.reduceat(own[code], edges)[:: 2 if whole else 1]
            return out * scale[rows, None]

        everything = np.arange(len(known))
        family = self.families.probabilities(sums(everything, self.families.columns))
        best = family.argmax(1)
        for f in np.unique(best).tolist():
            choice, rows = self.languages[self.families.classes[f]], np.flatnonzero(best == f)
            within = choice.probabilities(sums(rows, choice.columns))
            pick = within.argmax(1)
            for row, j, p in zip(rows.tolist(), pick.tolist(), family[rows, f] * within.max(1)):
                names[known[row]], scores[known[row]] = choice.classes[j], round(float(p), 6)
            for j in np.unique(pick).tolist() if typical else ():
                own, column = rows[pick == j], self.profiles.get(choice.classes[j])
                found = np.ones(len(own)) if column is None else sums(own, [column])[:, column]
                for row, value in zip(own.tolist(), found.tolist()):
                    likeness[known[row]] = round(value, 6)
        return names, scores, likeness


def _one_versus_one(classes: list[str], x: list[Row], label: np.ndarray, columns: list[np.ndarray]) -> Choice:
    made = Choice(classes)
    of = {c: np.flatnonzero(label == c) for c in classes}
    for a, b in itertools.combinations(range(len(classes)), 2):
        rows = np.sort(np.concatenate([of[classes[a]], of[classes[b]]]))
        w, bias, slope = fit_svm(x, rows, np.where(label[rows] == classes[a], 1.0, -1.0))
        made.pairs.append((a, b))
        made.columns.append(len(columns))
        made.bias.append(bias)
        made.slope.append(slope)
        columns.append(w)
    return made


def profile(x: list[Row]) -> np.ndarray | None:
    """The column whose sum over a text is 0 for n-grams at random and 1 for the median of every second row, which the frequencies leave out."""
    if len(x) < 2:
        return None
    learned = x[::2]
    mean = np.bincount(np.concatenate([at for at, _ in learned]), np.concatenate([v for _, v in learned]), len(ORDERS) << BITS) / len(learned)
    logs = np.log(mean / SCALE + UNSEEN).reshape(len(ORDERS), -1)
    column = (logs - logs.mean(1, keepdims=True)).ravel()
    whole = float(np.median([v @ column[at] for at, v in x[1::2]]))
    return (column / whole).astype(np.float32) if whole > 0 else None


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, all_rows: int = ALL_ROWS, families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    """A model of every language, from at most per_language rows of each and all_rows of all, chosen by a hash of their ids.

    The sample comes to the driver as lists of n-grams: all_rows of them at most,
    but LEAST_ROWS of each language, however many there are. Rows without a
    language, and texts that are null or have no letter, teach nothing; of rows
    with equal ids and texts some may be chosen, like any others.
    """
    named = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in named.groupBy("lang").count().collect()}
    least = max(min(per_language, LEAST_ROWS), min(per_language, all_rows // max(1, len(counts))))
    # Rows of equal ids differ in their draw, so that it stays a sample where one id has very many.
    draw = F.pmod(F.xxhash64("id", "text", F.lit("sample")), F.lit(1 << 40))
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, 1.2 * least / n + 10 / n)))]) if counts else F.create_map().cast("map<string,double>")
    schema = T.StructType([T.StructField("at", T.BinaryType()), T.StructField("value", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> dict:
        made = features(batch.column("text").to_pylist())
        return {"at": [a.tobytes() for a, _ in made], "value": [v.tobytes() for _, v in made]}

    chosen = named.withColumn("draw", draw).filter(F.col("draw") < F.element_at(share, F.col("lang")) * (1 << 40)).select("draw", "lang", "text")
    found = map_texts(chosen, ["draw", "lang", "text"], schema, run, "text", carry=True).drop("text")
    # Of equal rows, which share a draw, one is kept; each language's least draws are the sample.
    order = W.partitionBy("lang").orderBy("draw")
    rows = found.dropDuplicates(["lang", "draw"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= least).drop("draw").collect()
    rows.sort(key=lambda r: (r["lang"], r["rank"]))
    x = [(np.frombuffer(r["at"], np.uint16), np.frombuffer(r["value"], np.float32)) for r in rows]
    lang = np.array([r["lang"] for r in rows], object)
    of = {code: name for name, codes in families.items() for code in codes}
    known = sorted(set(lang))
    groups: dict[str, list[str]] = {}
    for code in known:
        groups.setdefault(of.get(code, code), []).append(code)
    columns: list[np.ndarray] = []
    family = _one_versus_one(sorted(groups), x, np.array([of.get(c, c) for c in lang], object), columns)
    within = {name: _one_versus_one(codes, x, lang, columns) for name, codes in sorted(groups.items())}
    profiles = {}
    for code in known:
        if (own := profile([x[i] for i in np.flatnonzero(lang == code)])) is not None:
            profiles[code] = len(columns)
            columns.append(own)
    weights = np.column_stack(columns).astype(np.float32) if columns else np.zeros((len(ORDERS) << BITS, 0), np.float32)
    return Model(weights, family, within, profiles)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, typical: bool = False) -> DataFrame:
    """lang_pred and score (0 to 1) for every row; with `typical` also how typical the text is of that language.

    A text that is null or has no letter is 'und' with score 0, and so is every
    text if nothing was learned. Repeated rows get the same prediction each; an
    empty table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields + [T.StructField("typical", T.DoubleType())] * typical)

    def run(batch: pa.RecordBatch) -> dict:
        names, scores, likeness = shared.value.predict(batch.column(text_col).to_pylist(), typical)
        return {"lang_pred": names, "score": scores, "typical": likeness}

    return map_texts(df, [id_col, text_col], schema, run, text_col, carry)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(fold("doc_id", 3) != 1), "doc_id", "text", "lang")
    return predict(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
