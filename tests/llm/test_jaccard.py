import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import op4_jaccard as jaccard


def brute(rows, n, percent):
    """{row number: (set size, least id it reaches)} by comparing all pairs that share a shingle."""
    sets, inverse = [], defaultdict(list)
    for k, (i, text) in enumerate(rows):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets.append(frozenset(tuple(words[a : a + n]) for a in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else []))
        for s in sets[-1]:
            inverse[s].append(k)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, own in enumerate(sets):
        for j, common in Counter(j for s in own for j in inverse[s] if j > k).items():
            if rows[k][0] is not None and rows[j][0] is not None and 100 * common >= percent * (len(own) + len(sets[j]) - common):
                parent[find(j)] = find(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return sorted((str(i), len(sets[k]), str(least[find(k)] if i is not None else None)) for k, (i, _) in enumerate(rows))


def check(df, n, percent, **more):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.link_components(df, n=n, percent=percent, **more).collect())
    assert got == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], n, percent)


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (2, 50)])
def test_against_brute_force(docs, n, percent):
    check(docs, n, percent)


def test_signatures_of_several_classes(docs):
    """With 7 bits nearly every signature stands for several classes, which are told apart by the other 64."""
    check(docs, 4, 85, signature_bits=7)


def test_odd_rows(odd, empty):
    check(odd, 4, 85)
    assert jaccard.link_components(empty).count() == 0


def test_near_copies_of_many_degrees(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    rows = []
    for k in range(160):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = f"x{rng.randint(0, 9999)}"
        rows.append((k, " ".join(own[: rng.choice([120, 120, 110])])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, 4, 85)
    check(df, 3, 70)


def test_pairs_keep_all_that_reach_the_threshold():
    """A pair of equal-size sets that reaches the threshold shares l shingles in the prefixes that l asks for."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m = rng.integers(3, 40, 2)
        pool = rng.permutation(60)
        a, b = np.sort(rng.choice(pool, n, False)), np.sort(rng.choice(pool, m, False))
        common = len(np.intersect1d(a, b))
        for percent in (50, 80, 85):
            if 100 * common < percent * (n + m - common):
                continue
            need = jaccard.overlap(int(n), int(m), percent)
            for k in jaccard.LENGTHS:
                if k <= common:
                    assert len(np.intersect1d(a[: n - need + k], b[: m - need + k])) >= k


def test_common_shingles_in_blocks(spark, monkeypatch):
    """Shingles that most classes hold, of sizes that can and cannot reach each other, with blocks of few classes and hot shingles set apart."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "HOT", 8)
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "RANGE", 200)
    rng = random.Random(12)
    common = [f"c{k}" for k in range(30)]
    rows = [(k, " ".join([*common[: rng.choice([4, 12, 30])], *[f"own{k}x{j}" for j in range(rng.randint(0, 8))]] * rng.randint(1, 2))) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    classes = jaccard._Classes(df, "doc_id", "text", 2)
    assert len(classes.hot[0]) > 20 and (np.diff(classes.hot[0].astype(float)) > 0).all() and classes.parts > 4
    check(df, 2, 70)
    check(df, 1, 85)


def test_pairs_need_no_more_than_their_overlap():
    """Sets of 4 and 3 shingles that share 3 reach 70 % with a lengthening of 4, which asks for more than they have."""
    search = jaccard._Pairs(70)
    rows = [(token, sig, sig, n, pos, 0, 0, 0, 4) for token in (1, 2, 3) for sig, n, pos in ((10, 4, token), (11, 3, token - 1))]
    names = ["token", "sig", "label", "n", "pos", "block", "one", "other", "length"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
    found = [r for b in search.pairs(iter([batch])) for r in b.to_pylist()]
    assert found == 3 * [{"a": 10, "b": 11, "need": 3}]


def test_lengthened_prefixes_of_all_sizes():
    rng = np.random.default_rng(2)
    for _ in range(600):
        n, m = rng.integers(1, 12, 2)
        pool = rng.permutation(14)
        a, b = np.sort(rng.choice(pool, n, False)), np.sort(rng.choice(pool, m, False))
        common = len(np.intersect1d(a, b))
        for percent in (50, 70, 85):
            if 100 * common >= percent * (n + m - common):
                need = jaccard.overlap(int(n), int(m), percent)
                for k in jaccard.LENGTHS:
                    assert len(np.intersect1d(a[: n - need + k], b[: m - need + k])) >= min(k, need)


@pytest.mark.parametrize("n,percent", [(4, 85), (1, 70)])
def test_links_are_all_pairs(spark, n, percent):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice([base[:4], base[:3], base[1:4], base[10:24], [*base[10:23], "y"], [*base[10:23], f"x{k}"], base[10:22], base[8:39], [*base[8:39], f"x{k}"]]))) for k in range(60)]
    rows += [(100, None), (101, ""), (None, " ".join(base[:4]))]
    members, pairs = jaccard.links(spark.createDataFrame(rows, "doc_id long, text string"), n=n, percent=percent)
    of = {r.doc_id: r["class"] for r in members.collect()}
    found = [(r.a, r.b) for r in pairs.collect()]
    assert len(found) == len(set(found)) and all(a < b for a, b in found) and len(of) == 60
    sets = {k: {tuple(w[a : a + n]) for a in range(max(1, len(w) - n + 1))} for k, t in rows if k is not None and (w := (t or "").split())}
    for i in of:
        for j in of:
            both = len(sets[i] & sets[j])
            want = 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)
            assert want == (of[i] == of[j] or (min(of[i], of[j]), max(of[i], of[j])) in set(found))
    assert found


def test_parities_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(4)
    pool = rng.integers(-(1 << 62), 1 << 62, 9000)
    kept = [rng.choice(pool, n, False) for n in (1, 3, 60, 64, 65, 500, 4000)]
    kept += [np.concatenate([s[: len(s) * 3 // 4], rng.integers(-(1 << 62), 1 << 62, max(1, len(s) // 5))]) for s in kept]
    bits = np.array([*map(jaccard.parities, kept), None], object)
    x, y = map(np.ravel, np.indices((len(bits), len(bits))))
    told = jaccard.differing(bits, x, y)
    for a, b, d in zip(x.tolist(), y.tolist(), told.tolist()):
        assert d <= (len(np.setxor1d(kept[a], kept[b])) if max(a, b) < len(kept) else 0)
    assert told[(x == 5) & (y == 12)][0] > 200 and not jaccard.differing(bits, x[:0], y[:0]).size


def test_crowds_that_link_with_nothing_make_few_candidates(spark):
    """Copies of one text that most pairs of differ a little too much in, by the parities as without them."""
    rng = random.Random(21)
    rows = []
    for k in range(150):
        own = [f"c{j}" for j in range(120)]
        for j in rng.sample(range(120), 6):
            own[j] = f"x{k}x{j}"
        rows.append((k, " ".join(own)))
    _, entries = jaccard._compared(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5, 55, 64)
    cells = jaccard._cells(jaccard._lengthened(entries, None, 55), 55)
    dealt = jaccard.written(cells.repartition(4, "token", "one", "other").sortWithinPartitions("token", "one", "other"))
    found = lambda df: df.coalesce(1).sortWithinPartitions("token", "one", "other").mapInArrow(jaccard._Pairs(55).pairs, "a long, b long, need long")
    made, whole = found(dealt), found(dealt.drop("shared", "bits"))
    linked = [{(r.a, r.b) for r in jaccard._verified(df.select("a", "b").distinct(), entries, 55).collect()} for df in (made, whole)]
    assert linked[0] == linked[1] and len(linked[0]) > 5
    assert 4 * made.count() < whole.count()
