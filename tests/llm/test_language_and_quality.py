import math
import re
from collections import Counter

import numpy as np

from strandloom.llm import op2_language, op5_quality

SF = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op2_language.op2_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_family_comes_first(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = op2_language.fit(docs, "doc_id", "text", "lang", per_language=50)
    assert model.families.classes == ["germanic", "romance"]
    assert {f: c.classes for f, c in model.languages.items()} == {"germanic": ["de", "en"], "romance": ["es", "fr"]}


def test_all_languages_are_learned(spark):
    """However many there are, and although only the winning family's machines are asked."""
    rng = np.random.default_rng(2)
    names = ["en", "de", "fr", *(f"x{k}" for k in range(17))]
    alphabet = {lang: rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5, False) for lang in names}
    text = lambda lang: " ".join("".join(rng.choice(alphabet[lang], rng.integers(2, 7))) for _ in range(30))
    rows = [(20 * k + j, text(lang), lang) for k in range(30) for j, lang in enumerate(names)]
    df = spark.createDataFrame([*rows, *rows[:40], (None, None, None)], "doc_id long, text string, lang string")
    model = op2_language.fit(df, "doc_id", "text", "lang", per_language=20)
    assert sorted(c for choice in model.languages.values() for c in choice.classes) == sorted(names)
    fresh = [text(lang) for lang in names for _ in range(5)]
    got, scores, typical = model.predict(fresh)
    assert np.mean([g == lang for g, lang in zip(got, [x for x in names for _ in range(5)])]) > 0.95
    for k, t in enumerate(fresh):  # a text is scored alone as it is among others, and as all machines together say
        assert model.predict([t]) == ([got[k]], [scores[k]], [typical[k]])
        codes, start, end = op2_language.ngrams([t])
        sums = np.array([[sum(model.weights[c[start[0] : end[0]], m].astype(float).sum() for c in codes) * op2_language.SCALE / (end[0] - start[0]) for m in range(model.weights.shape[1])]])
        family = model.families.probabilities(sums)[0]
        own = model.languages[model.families.classes[family.argmax()]]
        within = own.probabilities(sums)[0]
        assert (own.classes[within.argmax()], round(family.max() * within.max(), 4)) == (got[k], round(scores[k], 4))


def test_languages_of_odd_rows(odd, empty):
    model = op2_language.fit(odd, "doc_id", "text", "lang")
    got = op2_language.predict(odd, model).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (2, 3, 4, 5))
        assert r.lang_pred != "und" or r.score == 0
    nothing = op2_language.fit(empty, "doc_id", "text", "lang")
    assert {r.lang_pred for r in op2_language.predict(odd, nothing).collect()} == {"und"}
    assert op2_language.predict(empty, model).count() == 0
    carried = op2_language.predict(odd, model, carry=True)
    assert carried.columns.count("score") == 1 and "SHARD" in carried.columns


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op5_quality.op5_quality(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    good = np.array([r.score for r in got if r.quality == 1])
    bad = np.array([r.score for r in got if r.quality == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    x, v = rng.random((3, 12)), rng.random((12, 4))
    machine = op5_quality.Machine(0.5, rng.random(12), v)
    pairs = [sum(x[k, i] * x[k, j] * (v[i] @ v[j]) for i in range(12) for j in range(i)) for k in range(3)]
    assert np.allclose(machine.margin(x), 0.5 + x @ machine.weights + pairs)


def plain_features(text, chars):
    """{input: value} of one text, byte by byte and word by word."""
    data = (text or "").encode("utf-8", "replace")
    words, spans, at = [], [], 0
    for w in re.split(rb"[ \t-\r]+", data):
        if w:
            at = data.index(w, at)
            spans.append((at, at + len(w)))
            words.append(bytes(b + 32 if 65 <= b <= 90 else b for b in w))
            at += len(w)
    mask, base = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def hashed(w):
        x = sum((b + 1) * pow(base, k, 1 << 64) for k, b in enumerate(w)) & mask
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    tally = Counter(hashed(w) >> 64 - op5_quality.BITS for w in words)
    n, found = max(len(words), 1), {}
    found |= {k: (v / n) ** 0.5 for k, v in tally.items()}
    kinds = [sum(data.count(bytes([b])) for b in kind) for kind in op5_quality.KINDS]
    k = len(kinds)
    extra = [v / max(len(data), 1) for v in kinds]
    extra += [sum(a == b for a, b in zip(words, words[1:])) / n, len(tally) / min(n, 1 << op5_quality.BITS), sum(b - a for a, b in spans) / n / 20, sum(b - a > 15 for a, b in spans) / n]
    extra += [math.log1p(len(words)) / 10, math.log1p(kinds[op5_quality.KINDS.index(b"\n\r")]) / 10, float(not words), math.log1p(max(chars, 0)) / 12 if chars is not None else 0.0, float(chars is None)]
    assert len(extra) == k + 9
    return found | {(1 << op5_quality.BITS) + j: v for j, v in enumerate(extra)}


def test_scores_against_plain_sums(spark, odd):
    """Every score anew from the machine's weights: all pairs of inputs, one by one."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "n_chars").filter("n_chars < 800").limit(25)
    machine = op5_quality.fit(docs, labels)
    some = docs.union(odd.select("doc_id", "text", "n_chars").filter("coalesce(n_chars, 0) < 5000"))
    got = {(r.doc_id, r.score) for r in op5_quality.score(some, machine).collect()}
    want = set()
    for r in some.collect():
        x = sorted((i, v) for i, v in plain_features(r.text, r.n_chars).items() if v)
        vectors, weights = machine.vectors.astype(float), machine.weights.astype(float)
        margin = machine.bias + sum(weights[i] * v for i, v in x) + sum(v * w * float(vectors[i] @ vectors[j]) for a, (i, v) in enumerate(x) for j, w in x[:a])
        want.add((r.doc_id, 1 / (1 + math.exp(-min(max(margin, -30), 30)))))
    close = lambda rows: sorted((str(i), s) for i, s in rows)
    assert [i for i, _ in close(got)] == [i for i, _ in close(want)]
    assert np.allclose([s for _, s in close(got)], [s for _, s in close(want)], atol=2e-4)


def test_repeated_ids_teach_once(spark):
    rows = [(k, f"text of some words {k}", 20) for k in range(40)]
    docs = spark.createDataFrame([*rows, *rows[:10] * 30, (0, "another text", 5)], "doc_id long, text string, n_chars long")
    once = spark.createDataFrame(rows, docs.schema)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, quality int")
    twice = labels.union(labels)
    one, other = op5_quality.fit(once, labels), op5_quality.fit(docs, twice)
    assert np.array_equal(one.weights, other.weights) and one.bias == other.bias


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (8, 1), (7, 0), (5, 0), (2, None), (None, 1)], "doc_id long, quality int")
    machine = op5_quality.fit(odd, labels)
    got = op5_quality.score(odd, machine).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert op5_quality.fit(odd, labels.filter("false")) is None
    assert {r.score for r in op5_quality.score(odd, None).collect()} == {0.5}
    assert op5_quality.score(empty, machine).count() == 0


def test_probabilities_of_many_classes():
    """A class that wins all of its machines has probability 1, however many classes there are."""
    for k in (2, 3, 5):
        pairs = [(a, b) for a in range(k) for b in range(a + 1, k)]
        choice = op2_language.Choice(list("abcde"[:k]), pairs, list(range(len(pairs))), [0.0] * len(pairs), [1.0] * len(pairs))
        p = choice.probabilities(np.full((1, len(pairs)), 400.0))[0]
        assert np.allclose(p, [(k - 1 - a) / (k - 1) for a in range(k)])
