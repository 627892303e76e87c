import itertools
import math
import random
import time

import numpy as np

import plain_phasing
import pytest
from test_plain_model import per_read
from test_solver import frame, matrix

from strandloom import catalog
from strandloom.operators import contraction, cut, solver
from strandloom.operators import reads as read_operators


def sample(seed, n=9, reads=14):
    rng = random.Random(seed)
    rows = []
    for _ in range(reads):
        a = rng.randrange(0, n - 1)
        rows.append((a, [rng.choice([0, 1, 0, 1, -1]) for _ in range(rng.randint(2, min(5, n - a)))]))
    return rows


def likelihood(phase, of, variant, allele):
    p = 10 ** (-cut.QUALITY / 10)
    total = 0.0
    for r in set(of.tolist()):
        hit = phase[variant[of == r]] == allele[of == r]
        total += math.log10(math.prod(np.where(hit, 1 - p, p).tolist()) + math.prod(np.where(hit, p, 1 - p).tolist()))
    return total


def cut_from_scratch(phase, of, variant, allele, seed):
    """The cut from one edge, where every score is the difference of two likelihoods of all calls added so far."""
    side = {seed[0]: 0, seed[1]: 1}
    best = (0.0, set())
    base = likelihood(phase, of, variant, allele)

    def of_added(sides):
        at = np.isin(variant, list(sides))
        turned = phase.copy()
        turned[[i for i, t in sides.items() if t]] ^= 1
        return likelihood(turned, of[at], variant[at], allele[at]), turned

    while True:
        whole = likelihood(of_added(side)[1], of, variant, allele) - base
        if round(whole, 9) > round(best[0], 9):
            best = (whole, {i for i, t in side.items() if t})
        pulls = {i: round(of_added({**side, i: 0})[0] - of_added({**side, i: 1})[0], 9) for i in range(len(phase)) if i not in side}
        i = max(pulls, key=lambda i: (abs(pulls[i]), -i), default=None)
        if i is None or pulls[i] == 0:
            return best
        side[i] = int(pulls[i] < 0)


def calls_of(seed, n=12):
    rows = [(a, r) for a, r in sample(seed, n=n, reads=40) if sum(x >= 0 for x in r) > 1]
    of = np.array([k for k, (_, r) in enumerate(rows) for x in r if x >= 0])
    variant = np.array([a + j for a, r in rows for j, x in enumerate(r) if x >= 0])
    return of, variant, np.array([x for _, r in rows for x in r if x >= 0])


def test_a_cut_grows_as_with_likelihoods_from_scratch():
    rng, gains = random.Random(5), 0
    for seed in range(12):
        of, variant, allele = calls_of(seed)
        phase = np.array([rng.randint(0, 1) for _ in range(12)])
        by_variant = np.argsort(variant, kind="stable")
        bounds = np.searchsorted(variant[by_variant], np.arange(13))
        ends = (int(variant[0]), int(variant[1]))
        want, turned = cut_from_scratch(phase, of, variant, allele, ends)
        got, reversed_ = cut._grow(np.where(allele == phase[variant], 1, -1), of, variant, np.bincount(of), by_variant, bounds, ends)
        assert abs(got - want) < 1e-6 and set(reversed_) == turned
        gains += got > 0
    assert gains


def test_cuts_find_planted_haplotypes_in_a_long_area():
    """2000 variants of one area: memory and time stay linear, and a phase with reversed stretches is mended."""
    rng = np.random.default_rng(1)
    n = 2000
    truth = rng.integers(0, 2, n)
    first = rng.integers(0, n - 12, 6000)
    of, variant = np.repeat(np.arange(6000), 12), (first[:, None] + np.arange(12)).ravel()
    allele = truth[variant] ^ np.repeat(rng.integers(0, 2, 6000), 12) ^ (rng.random(len(variant)) < 0.02)
    phase = truth.copy()
    phase[700:1300] ^= 1
    began = time.monotonic()
    better = cut.improve_by_cuts(phase, of, variant, allele)
    assert time.monotonic() - began < 60
    seen = np.isin(np.arange(n), variant)
    assert (better ^ truth)[seen].min() == (better ^ truth)[seen].max()


def test_areas_without_fragments_stay():
    none = np.zeros(0, np.int64)
    assert cut.improve_by_cuts(np.array([0, 1]), none, none, none).tolist() == [0, 1]


def test_exact_correction_against_all_haplotypes():
    for seed in range(15):
        rows = sample(seed)
        want = min(
            sum(min(w := sum(x >= 0 and x != h[a + j] for j, x in enumerate(r)), sum(x >= 0 for x in r) - w) for a, r in rows)
            for h in itertools.product((0, 1), repeat=9)
        )
        assert cut.exact_mec(rows, 0, 8) == want


def test_exact_correction_looks_at_a_read_where_it_lies_only():
    """A long area: each read is asked for its length as often as it has variants, not once for each variant of the area."""
    asked = []

    class Row(list):
        def __len__(self):
            asked.append(1)
            return super().__len__()

    rows = [(s, Row([s // 2 % 2, 1, 0, -1])) for s in range(400)]
    assert cut.exact_mec(rows, 0, 402) == cut.exact_mec([(s, list(r)) for s, r in rows], 0, 402) > 0
    assert len(asked) < 10 * len(rows)


def test_cuts_never_lower_the_likelihood():
    rng = random.Random(3)
    for seed in range(10):
        of, variant, allele = calls_of(seed)
        phase = np.array([rng.randint(0, 1) for _ in range(12)])
        better = cut.improve_by_cuts(phase, of, variant, allele)
        assert likelihood(better, of, variant, allele) >= likelihood(phase, of, variant, allele) - 1e-9


def arrays_made(monkeypatch, run):
    """How often something is done with numpy.repeat, as a mark of array work that costs the same for one item as for a hundred."""
    made, repeat = [], np.repeat
    with monkeypatch.context() as patch:
        patch.setattr(np, "repeat", lambda *given, **named: made.append(1) or repeat(*given, **named))
        run()
    return len(made)


@pytest.mark.parametrize("which", ["improve_by_cuts", "contraction_cut"])
def test_a_cut_makes_no_arrays_for_each_variant(monkeypatch, which):
    of, variant, allele = calls_of(3)
    of, variant, allele = (np.concatenate([x + j * step for j in range(40)]) for x, step in ((of, of.max() + 1), (variant, 9), (allele, 0)))
    phase = np.array([s * 7 % 3 % 2 for s in range(variant.max() + 1)])
    better = cut.improve_by_cuts if which == "improve_by_cuts" else lambda *given: contraction.contraction_cut(*given)[1]
    assert arrays_made(monkeypatch, lambda: better(phase, of, variant, allele)) < 20
    assert likelihood(better(phase, of, variant, allele), of, variant, allele) >= likelihood(phase, of, variant, allele) - 1e-9


def test_paths_that_reads_leave(spark):
    paths = spark.createDataFrame([("c", "p", s, s % 2) for s in range(4)], "chrom string, path string, snp_idx long, bit int")
    inside = [("c", 1, 0, 0), ("c", 1, 1, 0), ("c", 2, 2, 1), ("c", 2, 3, -1)]
    shape = "chrom string, rid long, snp_idx long, allele int"
    assert cut.mec_path(paths, spark.createDataFrame(inside, shape)).first().mec == 1
    assert cut.mec_path(paths, spark.createDataFrame([*inside, ("c", 2, 4, 1)], shape)).first().mec == -1


def test_deep_areas_keep_their_reads(spark):
    """The registered query uses every read of an area up to 15 over a variant."""
    sf = "/root/testdata/sf0.001"
    own, _, areas = catalog._areas(spark, sf)
    got = {(r.chrom, r.bubble): (r.n_reads, r.mec) for r in catalog.tangle_dp(spark, sf).collect()}
    reads = {}
    for r in own.orderBy("rid", "snp_idx").collect():
        reads.setdefault((r.chrom, r.rid), []).append((r.snp_idx, r.allele))
    deep = 0
    for a in areas.collect():
        rows = [(r[0][0], [x for _, x in r]) for (chrom, _), r in reads.items() if chrom == a.chrom and a.l_bound <= r[0][0] and r[-1][0] <= a.r_bound]
        depth = max(sum(s <= c < s + len(x) for s, x in rows) for c in range(a.l_bound, a.r_bound + 1))
        if depth <= cut.MOST_COVERAGE:
            assert got[a.chrom, a.bubble] == (len(rows), cut.exact_mec(rows, a.l_bound, a.r_bound))
            deep += depth > 6
    assert deep


def test_cuts_are_of_the_real_blocks(spark):
    """The registered query keeps the majority blocks, also those that are longer than 40 variants or straddle a multiple of 40."""
    sf = "/root/testdata/sf0.001"
    own, made = catalog._majority(spark, sf)
    blocks = {(r.chrom, r.block, r.snp_idx): r.phase for r in made.collect()}
    got = {(r.chrom, r.block, r.snp_idx): r.phase for r in catalog.improve_by_cuts(spark, sf).collect()}
    assert got.keys() == blocks.keys()
    assert max(s for _, _, s in blocks) > 40 and any(b // 40 != s // 40 for _, b, s in blocks)
    frags = {}
    for r in cut.fragments(own).orderBy("chrom", "frag", "variant").collect():
        frags.setdefault(r.chrom, []).append((r.frag, r.variant, r.allele))
    for chrom, block in {k[:2] for k in blocks}:
        snps = sorted(s for c, b, s in blocks if (c, b) == (chrom, block))
        rows = [(f, snps.index(v), a) for f, v, a in frags[chrom] if v in snps]
        _, of = np.unique([f for f, _, _ in rows], return_inverse=True)
        want = cut.improve_by_cuts(np.array([blocks[chrom, block, s] for s in snps]), of, np.array([v for _, v, _ in rows]), np.array([a for _, _, a in rows]))
        assert [got[chrom, block, s] for s in snps] == want.tolist()


def plain_contraction(phase, of, variant, allele):
    """The best cut where every score is the difference of two likelihoods of all calls on the shores so far: O(N^2) of them a cut."""
    n, draws = len(phase), contraction.Draws()
    weight, size = {}, {r: int((of == r).sum()) for r in set(of.tolist())}
    odds = math.log10((0.98004737685031118**2 + 0.019952623149688802**2) / (2 * 0.98004737685031118 * 0.019952623149688802))
    for r in size:
        own = sorted((v, a) for v, a, f in zip(variant.tolist(), allele.tolist(), of.tolist()) if f == r)
        for (u, a), (v, b) in zip(own, own[1:]):
            w = (1 if (a == phase[u]) == (b == phase[v]) else -1) * odds / (size[r] - 1)
            weight[u, v] = weight[v, u] = weight.get((u, v), 0) + w
    edges = sorted(weight)
    heavy = sorted(edges, key=lambda e: (-round(weight[e], 5), e))[: min(5, len(edges) // 2)]
    base, best, idle = likelihood(phase, of, variant, allele), None, 0

    def partly(sides):
        at = np.isin(variant, list(sides))
        turned = phase.copy()
        turned[[i for i, t in sides.items() if t]] ^= 1
        return likelihood(turned, of[at], variant[at], allele[at])

    for turn in range(len(heavy) + min(100, max(1, n // 10))):
        if turn < len(heavy):
            s, t = heavy[turn]
        elif draws() < 0.5:
            s, t = edges[int(draws() * len(edges))]
            if round(weight[s, t], 9) >= 1:
                continue
        else:
            s, t = int(draws() * n), None
        sides = {s: 0} if t is None else {s: 0, t: 1}
        while len(sides) < n:
            pulls = {i: round(partly({**sides, i: 0}) - partly({**sides, i: 1}), 9) for i in range(n) if i not in sides}
            i = max(pulls, key=lambda i: (abs(pulls[i]), -i))
            sides[i] = 0 if pulls[i] > 0 else 1 if pulls[i] < 0 or 1 not in sides.values() else int(draws() >= 0.5)
        if 1 not in sides.values():
            continue
        gain = round(partly(sides) - base, 9)
        if best is None or gain > best[0]:
            best = gain, sides
        else:
            idle += 1
            if idle > 5:
                break
    if best is None or best[0] <= 0:
        return 0.0, phase
    return best[0], phase ^ np.array([best[1][i] for i in range(n)])


def test_contraction_gives_the_cuts_of_likelihoods_from_scratch():
    """The same seeds and draws, scores that are kept up to date against scores from scratch; also variants that no fragment has."""
    rng, better = random.Random(11), 0
    for seed in range(10):
        of, variant, allele = calls_of(seed)
        phase = np.array([rng.randint(0, 1) for _ in range(14)])
        gain, made = contraction.contraction_cut(phase, of, variant, allele)
        want, path = plain_contraction(phase, of, variant, allele)
        assert abs(gain - want) < 1e-6 and made.tolist() == path.tolist()
        assert likelihood(made, of, variant, allele) >= likelihood(phase, of, variant, allele) - 1e-9
        better += gain > 0
    assert better > 5
    none = np.zeros(0, np.int64)
    assert contraction.contraction_cut(np.array([0, 1]), none, none, none)[1].tolist() == [0, 1]


def test_heap_against_sorting():
    rng = random.Random(2)
    keys = {i: float(rng.randint(0, 9)) for i in range(60)}
    heap = contraction.MaxHeap(keys)
    while keys:
        for _ in range(3):
            i = rng.choice(list(keys))
            keys[i] = float(rng.randint(0, 9))
            heap.update(i, keys[i])
        want = min(keys, key=lambda i: (-keys[i], i))
        assert heap.pop() == want
        del keys[want]
    assert len(heap) == 0


def test_generator_is_that_of_posix():
    """The first numbers of drand48 without a seed."""
    draws = contraction.Draws()
    assert [f"{draws():.6f}" for _ in range(3)] == ["0.396465", "0.840485", "0.353336"]


@pytest.mark.parametrize("k", [2, 3])
def test_tangles_are_cut(spark, k):
    """Paths, errors and rewritten weights of every tangle against the plain model's areas; no cut raises an area's errors."""
    rows, _ = matrix(31, n=90, depth=12, errors=0.2, size=12)
    own = read_operators.informative_reads(frame(spark, rows))
    solved = solver.solve_stages(own, k, ("tips", "closed", "areas")).cache()
    pairs = contraction.tangle_pairs(own, solver.edges_of(solved, "tips"), solver.areas_of(solved), k)
    paths, weights = contraction.tangle_cut(own, solver.edges_of(solved, "closed"), pairs, k)
    model = plain_phasing.Chromosome(per_read(rows), k)
    model.remove_tips()
    model.solve_areas()
    tangles = {(a["left"], a["right"]): a for a in model.solved if not 0 < a["ways"] < 256}
    closed = {(r.s, r.e): r.weight for r in solver.edges_of(solved, "closed").collect()}
    got = paths.collect()
    assert tangles and {(r.l_bound, r.r_bound) for r in got} == set(tangles)
    kept = {}
    for r in weights.collect():
        kept.setdefault(r.bubble, {})[r.s, r.e] = r.weight
    for r in got:
        own = tangles[r.l_bound, r.r_bound]["reads"]
        wrong = [[int(r.path[t - r.l_bound]) != a for t, a in read if a >= 0] for read in own]
        assert r.n_reads == len(own) and r.mec == sum(min(sum(x), len(x) - sum(x)) for x in wrong) <= r.seed_mec
        on = {(r.l_bound + j, e) for j in range(len(r.path) - k) for w in (r.path[j : j + k + 1],) for e in (int(w, 2), (2 << k) - 1 - int(w, 2))}
        assert kept.get(r.bubble, {}) == {x: closed[x] for x in on if x in closed}
