import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import reads, solver
from strandloom.plans import phasing

SHAPE = "chrom string, rid long, snp_idx long, allele int"


def matrix(seed, n=60, depth=8, errors=0.08, gaps=0.05, size=7, holes=()):
    """Simulated calls and the true phases."""
    rng = random.Random(seed)
    truth = [rng.randint(0, 1) for _ in range(n)]
    rows = []
    for rid in range(n * depth // size):
        start, haplotype = rng.randrange(0, n - 2), rng.randint(0, 1)
        for s in range(start, min(n, start + rng.randint(2, size))):
            if s in holes:
                break
            allele = -1 if rng.random() < gaps else truth[s] ^ haplotype ^ (rng.random() < errors)
            rows.append(("c", rid, s, int(allele)))
    return rows, truth


def frame(spark, rows):
    return spark.createDataFrame(rows, SHAPE)


def phases(spark, rows, k=2):
    return {r.snp_idx: (r.ps_idx, r.phase) for r in phasing.phase(frame(spark, rows), k).collect()}


@pytest.mark.parametrize("k", [2, 3])
def test_phases_follow_the_truth(spark, k):
    rows, truth = matrix(3, n=100, depth=14, errors=0.02)
    got = phases(spark, rows, k)
    sets = {}
    for s, (ps, phase) in got.items():
        sets.setdefault(ps, []).append(phase ^ truth[s])
    wrong = sum(min(sum(x), len(x) - sum(x)) for x in sets.values())
    assert len(got) > 90 and wrong <= 3


def test_order_and_numbers_of_reads_do_not_matter(spark):
    rows, _ = matrix(5)
    names = list(range(1000))
    random.Random(9).shuffle(names)
    other = [(c, names[r], s, a) for c, r, s, a in rows]
    random.Random(8).shuffle(other)
    assert phases(spark, rows) == phases(spark, other)


def test_swapped_alleles_give_the_same_blocks(spark):
    """Reads count for both strands, so that exchanging all alleles changes nothing."""
    rows, _ = matrix(6)
    swapped = [(c, r, s, 1 - a if a >= 0 else a) for c, r, s, a in rows]
    assert phases(spark, rows) == phases(spark, swapped)


def test_islands_are_solved_on_their_own(spark):
    rows, _ = matrix(7, n=80, holes=(30, 55))
    whole = phases(spark, rows)
    islands = {r.island for r in reads.coverage_islands(reads.informative_reads(frame(spark, rows))).collect()}
    assert len(islands) > 1
    assert all(min(i for i in islands) <= ps for ps, _ in whole.values())
    for low in islands:
        own = {s for s, (ps, _) in whole.items() if ps >= low}
        assert all(whole[s][0] >= low for s in own)


def test_graph_stays_symmetric_and_decided(spark):
    for k in (2, 3, 4, 5):
        rows, _ = matrix(11, depth=10)
        own = reads.informative_reads(frame(spark, rows))
        full = (1 << (k + 1)) - 1
        weights = {(r.s, r.e): r.weight for r in solver.solve(own, k, "bubbles").collect()}
        assert all(weights[s, full - e] == w for (s, e), w in weights.items())
        out = {}
        for s, e in weights:
            out[s, e >> 1] = out.get((s, e >> 1), 0) + 1
        assert set(out.values()) <= {1}


def cost(block, first, chosen):
    """Error correction of reads against phases."""
    total = 0
    for start, row in chosen:
        wrong = [a != block[start + j - first] for j, a in enumerate(row) if a >= 0]
        total += min(sum(wrong), len(wrong) - sum(wrong))
    return total


def naive_correction(block, first, hint, rows):
    """Local correction, step by step, as its rules say."""
    block, last = list(block), first + len(block) - 1
    inside = [(s, r) for s, r in rows if s >= first and s + len(r) - 1 <= last]
    over = lambda lo, hi: [(s, r) for s, r in inside if s <= hi and s + len(r) - 1 >= lo]
    n = len(block)

    def turned(flags):
        out, now = [], 0
        for p, f in zip(block, flags):
            now ^= f
            out.append(p ^ now)
        return out

    for pattern in solver.PATTERNS:
        marks, i = [0] * n, 0
        while i + 5 <= n:
            chosen = over(first + i, first + i + 4)
            flags = [pattern >> (p - i) & 1 if i <= p < i + 5 else 0 for p in range(n)]
            if hint[first + i] and chosen and cost(turned(flags), first, chosen) < cost(block, first, chosen):
                marks = [a | b for a, b in zip(marks, flags)]
                i += 5
            else:
                i += 1
        block = turned(marks)
    i = 0
    while i < n:
        chosen = over(first + i, first + i)
        other = [p ^ (j == i) for j, p in enumerate(block)]
        if cost(other, first, chosen) < cost(block, first, chosen):
            block, i = other, i + 64
        i += 1
    marks, i = [0] * n, 1
    while i < n:
        chosen = over(first + i - 1, first + i - 1)
        if cost([p ^ (j >= i) for j, p in enumerate(block)], first, chosen) < cost(block, first, chosen):
            marks[i], i = 1, i + 64
        i += 1
    return turned(marks)


def test_correction_equals_the_stepwise_rules():
    rng = random.Random(13)
    for seed in range(25):
        rows, truth = matrix(seed, n=90, depth=6, errors=0.1)
        island = solver.Island(2, 0, 89, 90)
        per = {}
        for _, r, s, a in rows:
            per.setdefault(r, []).append((s, a))
        for own in per.values():
            island.add_read(*map(solver.np.array, zip(*own)))
        island.hint[:] = [rng.randint(0, 1) for _ in range(90)]
        first, size = rng.randint(0, 5), rng.randint(60, 80)
        block = [t ^ (rng.random() < 0.15) for t in truth[first : first + size]]
        inside = [(s, r) for s, r in island.reads if s >= first and s + len(r) <= first + len(block)]
        got = solver.Correction(first, block, island.hint[first : first + len(block)] != 0, inside).run()
        assert got == naive_correction(block, first, island.hint, [(s, r.tolist()) for s, r in island.reads])


def test_blocks_are_corrected_one_by_one(spark):
    """Blocks that overlap, one without reads, two chromosomes and skipped variants: each equals the stepwise rules, in a task of its own."""
    rng = random.Random(4)
    rows, blocks, hint, want = [], [], {}, {}
    for c in ("c", "d"):
        own, truth = matrix(ord(c), n=160, depth=7, errors=0.1)
        own = [(c, r, s, a) for _, r, s, a in own if rng.random() < 0.97]
        rows += own
        hint[c] = [rng.randint(0, 1) for _ in range(170)]
        per = {}
        for _, r, s, a in sorted(own):
            per.setdefault(r, {})[s] = a
        chosen = [(min(p), [p.get(s, -1) for s in range(min(p), max(p) + 1)]) for p in per.values()]
        for first, size in ((0, 70), (60, 50), (115, 45), (160, 8)):
            block = [t ^ (rng.random() < 0.15) for t in (truth + [0] * 10)[first : first + size]]
            blocks += [(c, 0, first, first + j, int(p)) for j, p in enumerate(block)]
            want[c, first] = naive_correction(block, first, hint[c], chosen)
    doubtful = spark.createDataFrame([(c, s) for c in hint for s, h in enumerate(hint[c]) if h], "chrom string, snp_idx long")
    made = solver.correct_blocks(frame(spark, rows), spark.createDataFrame(blocks, "chrom string, island long, block long, snp_idx long, phase int"), doubtful)
    got = {}
    for r in made.orderBy("snp_idx").collect():
        got.setdefault((r.chrom, r.block), []).append(r.phase)
    assert got == {key: [int(p) for p in block] for key, block in want.items()}


def test_overlaps():
    a, b, c, d = (0, [0] * 10), (2, [1] * 5), (6, [1] * 8), (20, [0] * 3)
    assert solver.de_overlap([d, c, b, a]) == [(0, [0] * 10 + [1] * 4), (20, [0] * 3)]


def test_odd_input(spark):
    assert phases(spark, []) == {}
    assert phases(spark, [("c", 1, 5, 1)]) == {}
    assert phases(spark, [("c", 1, 5, -1), ("c", 1, 6, -1)]) == {}
    with pytest.raises(ValueError):
        solver.solve(frame(spark, []), 6)
    lone = phases(spark, [("c", 1, 5, 1), ("c", 1, 6, 0), ("d", 1, 0, 1), ("d", 1, 1, 1)])
    assert set(lone) <= {0, 1, 5, 6}
    far = frame(spark, [("c", 1, 0, 1), ("c", 1, 3, 1)])
    assert reads.informative_reads(far).filter(F.col("allele") < 0).count() == 0
