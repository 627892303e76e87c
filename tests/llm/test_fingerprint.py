import functools
import hashlib
import random

import numpy as np
import pytest
import xxhash

from strandloom.llm import op3_fingerprint as lcp


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


def test_equal_substrings_share_interior_names():
    rng = random.Random(4)
    middle = words(rng, 200)
    for level in (1, 2, 3):
        both = [set(lcp.names([(words(rng, k) + " " + middle + " " + words(rng, 9)).encode()], level)[0].tolist()) for k in (1, 2, 7, 30)]
        inside = lcp.names([middle.encode()], level)[0].tolist()
        for own in both:
            missing = [n for n in inside if n not in own]
            assert len(missing) <= 4 * level + 2, (level, len(missing), len(inside))


def test_names_do_not_depend_on_the_batch():
    rng = random.Random(5)
    texts = [words(rng, rng.randint(0, 40)).encode() for _ in range(60)] + [b"", b"a", b"aaaa", b"ab", b"a" * 5000]
    found, first = lcp.names(texts, 2)
    for k, text in enumerate(texts):
        assert lcp.names([text], 2)[0].tolist() == found[first[k] : first[k + 1]].tolist()


def test_likeness_columns(spark):
    rng = random.Random(6)
    base = words(rng, 300)
    texts = [base, base, base + " more words", words(rng, 300), ""]
    sketches = lcp.sketches([t.encode() for t in texts])
    prints = [lcp.text_of(s) for s in sketches]
    assert prints[0] == prints[1] and lcp.likeness(sketches[0], sketches[1]) == 1
    pairs = [(prints[i], prints[j]) for i in range(5) for j in range(5)]
    got = spark.createDataFrame(pairs, "a string, b string").select(lcp.fingerprint_likeness(lcp.F.col("a"), lcp.F.col("b")).alias("x")).collect()
    assert np.allclose([r.x for r in got], [lcp.likeness(sketches[i], sketches[j]) for i in range(5) for j in range(5)])


M64 = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def plain_parse(symbols):
    """The names of one text's phrases, symbol by symbol."""
    runs = []
    for x in symbols:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    x = [plain_mix(s + n * 0xD6E8FEB86659FD93 & M64) if n > 1 else s for s, n in runs]

    def tossed(before, own, size):
        """The lowest bit in which two labels differ, and own's value of it."""
        if before == own:
            return 0
        k = next(k for k in range(size) if (before ^ own) >> k & 1)
        return 2 * k + (own >> k & 1)

    # What stands before a text doesn't matter: no phrase begins at its first labels, where that would show.
    label = [0] + [min(tossed(a, b, 64), 127) for a, b in zip(x, x[1:])]
    for size in (7, 4):
        label = [label[0]] + [tossed(a, b, size) for a, b in zip(label, label[1:])]
    cuts = [k for k in range(4, len(x) - 1) if label[k - 1] < label[k] > label[k + 1]]
    phrases = [x[a:b] for a, b in zip([0, *cuts], [*cuts, len(x)])] if x else []
    base = 0x9E3779B97F4A7C15
    return [plain_mix((sum(plain_mix(s) * pow(base, k, 1 << 64) for k, s in enumerate(p)) + len(p)) & M64) for p in phrases]


def plain_sketch(data):
    names = list(data)
    for _ in range(lcp.LEVELS):
        names = plain_parse(names)
    return sorted({n >> 32 for n in names})[: lcp.KEPT]


def plain_likeness(a, b):
    if not a and not b:
        return 1.0
    union = sorted({*a, *b})[: lcp.KEPT]
    j = len(set(union) & set(a) & set(b)) / len(union)
    return round(2 * j / (1 + j), 6)


def test_parsing_against_plain_rules():
    rng = random.Random(8)
    texts = [words(rng, rng.randint(0, 60)).encode() for _ in range(150)] + [b"", b"a", b"ab", b"aab" * 30, b"a" * 500, "漢字 🙂 é".encode() * 9, bytes(rng.randrange(256) for _ in range(3000))]
    for text, got in zip(texts, lcp.sketches(texts)):
        assert got.tolist() == plain_sketch(text)


def check(df, n):
    """Against fingerprints, edits and likeness computed symbol by symbol."""
    rows = sorted([(r.doc_id is not None, r.doc_id or 0, xxhash.xxh64_intdigest((r.text or "").encode(), 42) ^ 1 << 63, r.text or "") for r in df.collect()])
    got = lcp.edited_pairs(df).collect()
    assert len(got) == n == len(rows)
    sketch = functools.cache(lambda text: plain_sketch(text.encode()))
    spelled = lambda s: "".join(f"{x:08x}" for x in s)
    want = []
    for k, (_, i, _, text) in enumerate(rows):
        after, half = rows[(k + 1) % n][3], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = sketch(text), sketch(edited), sketch(after)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), spelled(a), spelled(b), plain_likeness(a, b), plain_likeness(a, c)))
    assert sorted((r.doc_id or 0, *r[1:]) for r in got) == sorted(want)


def test_one_id_of_many_rows(spark):
    """Rows without an id, a third of all, are spread over ranges; each still meets the next one."""
    df = spark.range(90).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS doc_id", "concat('some text of row ', id, ' and more words') AS text")
    check(df, 90)
    parts = {r.part for r in lcp.with_next(df, "doc_id", "text").filter("no_id AND extra = 0").collect()}
    assert len(parts) > 1
    check(df.withColumn("doc_id", lcp.F.lit(None).cast("long")), 90)
    with pytest.raises(TypeError):
        lcp.edited_pairs(df.withColumn("doc_id", lcp.F.lit("x")))


def test_edited_pairs(docs, odd, empty, spark):
    check(docs, docs.count())
    check(odd, odd.count())
    check(docs.filter("doc_id = 5"), 1)
    assert lcp.edited_pairs(empty).count() == 0


def test_half_of_the_words_kept(docs):
    got = lcp.edited_pairs(docs.filter("n_chars > 500")).collect()
    assert np.mean([r.near_edited for r in got]) > 0.4 > 0.1 > np.mean([r.near_next for r in got])
