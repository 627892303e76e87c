import random
import re

from strandloom.llm import common as shared
from strandloom.llm import op10_decontaminate as tiling


def naive(item, text, least):
    """Words that greedy tiles cover, by trying all places for the longest match each time."""
    free_item, free_text, covered = [1] * len(item), [1] * len(text), 0
    while True:
        longest, matches = 0, []
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while a + n < len(item) and b + n < len(text) and free_item[a + n] and free_text[b + n] and item[a + n] == text[b + n]:
                    n += 1
                if n > longest:
                    longest, matches = n, []
                if n == longest:
                    matches.append((a, b))
        if longest < least:
            return covered
        for a, b in matches:
            if all(free_item[a : a + longest]) and all(free_text[b : b + longest]):
                free_item[a : a + longest] = free_text[b : b + longest] = [0] * longest
                covered += longest


def test_tiles_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        item = [rng.randint(1, 4) for _ in range(rng.randint(0, 30))]
        text = [rng.randint(1, 4) for _ in range(rng.randint(0, 40))]
        found = tiling.tiles(item, text, 3)
        assert sum(n for _, _, n in found) == naive(item, text, 3)
        assert all(item[a : a + n] == text[b : b + n] for a, b, n in found)


def table(spark, rows, name="doc_id"):
    return spark.createDataFrame(rows, f"{name} long, text string")


def expected(docs, items, least=tiling.MIN_MATCH, coverage=tiling.COVERAGE):
    """{doc: {item: coverage}} by tiling every text with every item, without seeds."""
    split = lambda t: [w for w in re.findall(r"[a-z0-9_]+", (t or "").lower())]
    out = {}
    for i, text in docs:
        own = {}
        for k, item in items:
            words = split(item)
            if k is not None and words:
                covered = naive(words, split(text), min(least, len(words))) / len(words)
                if covered >= coverage:
                    own[k] = max(own.get(k, 0), covered)
        out[i] = own
    return out


def test_hits_against_brute_force(spark, monkeypatch):
    """Which items are found and how far they are covered, with one block, with many that are mapped, and with many that Spark fetches."""
    rng = random.Random(6)
    draw = lambda n: [f"w{rng.randint(0, 25)}" for _ in range(n)]
    common = draw(7)
    items = [(k, " ".join((common if k % 3 == 0 else []) + draw(rng.choice([2, 4, 5, 9, 14])))) for k in range(30)] + [(30, None), (None, "w1 w2"), (31, ""), (3, "w3 w4 w5")]
    docs = [(100, None), (101, ""), (102, " ".join(common * 40))]
    for d in range(60):
        parts = [draw(rng.randint(0, 6)) for _ in range(2)]
        for _ in range(rng.randint(0, 3)):
            words = (rng.choice(items)[1] or "w9").split()
            a = rng.randint(0, len(words))
            parts.append(rng.choice([words, words[a:] + words[:a], words[: max(1, len(words) - 2)], words[:a] + ["x"] + words[a:]]))
        rng.shuffle(parts)
        docs.append((d, " ".join(w for p in parts for w in p)))
    want = expected(docs, items)
    shape = table(spark, docs), table(spark, items, "item_id")
    monkeypatch.setattr(tiling, "MET", 16)
    for block_bytes, mounted in ((1 << 20, True), (300, True), (300, False)):
        if not mounted:
            monkeypatch.setattr(shared, "mounted_dir", lambda spark: None)
        for r in tiling.decontaminate(*shape, block_bytes=block_bytes).collect():
            own = want[r.doc_id]
            assert r.item_ids == sorted(own) and r.contaminated == bool(own) and r.n_items == len(own)
            assert r.best_coverage == round(max(own.values(), default=0), 6)
            assert r.best_item == min((k for k in own if own[k] == max(own.values())), default=None)
    assert sum(map(bool, want.values())) > 20


def test_long_and_repetitive_texts(spark):
    """One word repeated, one very long word, and a passage that every item and document shares."""
    passage = " ".join(f"shared{k}" for k in range(50))
    items = [(k, f"{passage} own{k} more{k} words{k} of{k} it{k}") for k in range(300)] + [(1000, "yes " * 60)]
    docs = [(1, "yes " * 30_000), (2, "z" * 200_000), (3, (passage + " ") * 50), (4, passage + " own7 more7 words7 of7 it7")]
    got = {r.doc_id: r for r in tiling.decontaminate(table(spark, docs), table(spark, items, "item_id")).collect()}
    assert got[1].item_ids == [1000] and got[2].item_ids == []
    assert got[3].n_items == 300 and got[4].n_items == 300 and got[4].best_item == 7 and got[4].best_coverage == 1


def test_reordered_and_partial_passages(spark):
    words = [f"word{k}" for k in range(40)]
    item = " ".join(words)
    swapped = "Before this: " + " ".join(words[20:]) + ". And, first: " + " ".join(words[:20]).upper() + "!"
    half = " ".join(words[:20]) + " and nothing else"
    scattered = " x ".join(" ".join(words[k : k + 4]) for k in range(0, 40, 4))
    docs = table(spark, [(1, item), (2, swapped), (3, half), (4, scattered), (5, None), (6, ""), (7, "three short words here")])
    bench = table(spark, [(10, item), (11, None), (12, "..."), (13, "short words"), (None, item), (10, item)], "item_id")
    got = {r.doc_id: r for r in tiling.decontaminate(docs, bench).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {1, 2, 7}
    assert got[2].item_ids == [10] and got[2].best_coverage == 1 and got[7].item_ids == [13]
    assert got[3].best_item is None and got[3].best_coverage == 0 and len(got) == 7
    blocks = {r.doc_id: r for r in tiling.decontaminate(docs, bench, block_bytes=100).collect()}
    assert blocks == got


def test_odd_rows(spark, odd, empty):
    bench = table(spark, [(1, "no id but words in the text of this row")], "item_id")
    got = tiling.decontaminate(odd, bench, carry=True)
    assert got.count() == odd.count() and got.filter("contaminated").first().doc_id is None
    assert got.columns.count("contaminated") == 1 and "SHARD" in got.columns
    assert tiling.decontaminate(empty, bench).count() == 0
    assert not tiling.decontaminate(odd, bench.filter("false")).filter("contaminated").count()
