"""The island solver against the plain model of whole chromosomes."""

import numpy as np
import pandas as pd
import plain_phasing
import pytest
from pyspark.sql import functions as F
from test_solver import frame, matrix

from strandloom.operators import reads, solver


def per_read(rows):
    out = {}
    for _, rid, s, a in rows:
        out.setdefault(rid, []).append((s, a))
    return list(out.values())


def island(model):
    """An island of the whole chromosome with the model's tables."""
    calls = [("call", rid, s, a) for rid, r in enumerate(model.reads) for s, a in r]
    tables = [(kind, s, int(w, 2), c) for kind, table in (("node", model.count), ("edge", model.weight)) for (s, w), c in table.items()]
    pdf = pd.DataFrame(calls + tables + [("hint", s, 0, h) for s, h in model.hint.items()], columns=["kind", "a", "b", "c"])
    return solver._island(pdf, model.k, model.n, 0)


def edges(own):
    return {(int(s), f"{e:0{own.k + 1}b}"): int(own.weight[s, e]) for s, e in np.argwhere(own.weight > 0)}


def hints(own):
    return {int(s): int(own.hint[s]) for s in np.flatnonzero(own.hint)}


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_passes_equal_the_plain_rules(k):
    tips = areas = tangles = 0
    for seed in range(40):
        rows, _ = matrix(seed, n=70, depth=(5, 9, 18)[seed % 3], errors=(0.03, 0.1, 0.25)[seed // 3 % 3], size=(6, 9, 20)[seed % 3])
        calls = [r for r in per_read(rows)]
        model = plain_phasing.Chromosome(calls, k)
        # A chromosome without a gap in its coverage is one island; here the ends may lack reads.
        if min(r[0][0] for r in model.reads) > 0 or model.n < k + 3:
            continue
        own, before = island(model), dict(model.weight)
        assert edges(own) == model.weight
        model.remove_tips()
        own.remove_tips()
        assert edges(own) == model.weight and hints(own) == model.hint
        assert {(int(s), f"{w:0{k}b}") for s, w in np.argwhere(own.count > 0)} == set(model.count)
        tips += model.weight != before
        found = model.areas()
        assert [(a["left"], a["right"]) for a in found] == [(left, right) for left, right, _ in own.bubbles()]
        model.solve_areas()
        own.solve_bubbles()
        assert edges(own) == model.weight and hints(own) == model.hint
        assert own.blocks() == model.blocks()
        for area, (left, right, ways) in zip(found, own.areas, strict=True):
            assert (area["left"], area["right"]) == (left, right)
        areas += len(found)
        tangles += 3 in model.hint.values()
    assert areas and tangles and (tips or k > 3)


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_islands_together_equal_the_whole_chromosome(spark, k):
    """From the reads on, through the tables that Spark makes, with several islands and a chromosome that goes on behind the last read."""
    rows, _ = matrix(21 + k, n=120, depth=11, errors=0.09, size=9, holes=(40, 41, 90))
    own = reads.informative_reads(frame(spark, rows))
    sizes = spark.createDataFrame([("c", 125)], "chrom string, n_snp long")
    model = plain_phasing.Chromosome(per_read(rows), k, 125)
    model.remove_tips()
    got = {(r.s, f"{r.e:0{k + 1}b}"): r.weight for r in solver.solve(own, k, "tips", sizes).collect()}
    assert got == model.weight
    model.solve_areas()
    got = {(r.s, f"{r.e:0{k + 1}b}"): r.weight for r in solver.solve(own, k, "bubbles", sizes).collect()}
    assert got == model.weight
    blocks = {}
    for r in solver.solve(own, k, "blocks", sizes).orderBy("snp_idx").collect():
        blocks.setdefault((r.island, r.block), []).append((r.snp_idx, r.phase))
    assert sorted((b[0][0], [p for _, p in b]) for b in blocks.values()) == sorted(model.blocks())
    assert reads.coverage_islands(own).agg(F.countDistinct("island")).first()[0] > 1


def test_shares_and_kinds_of_areas(spark):
    rows, _ = matrix(31, n=90, depth=12, errors=0.2, size=12)
    own = reads.informative_reads(frame(spark, rows))
    model = plain_phasing.Chromosome(per_read(rows), 2)
    model.remove_tips()
    model.solve_areas()
    solved = solver.solve_stages(own, 2, ("areas", "shares", "blocks")).cache()
    got = [(r.l_bound, r.r_bound, r.ways, r.kind) for r in solver.areas_of(solved).orderBy("l_bound", "r_bound").collect()]
    kind = lambda n: "incomplete" if n == 0 else "simple" if n < 256 else "complex"
    assert got == sorted((a["left"], a["right"], min(a["ways"], 256), kind(a["ways"])) for a in model.solved)
    share = solver.shares_of(solved, reads.variant_counts(own)).first()
    tangled = sum(a["right"] - a["left"] + 1 for a in model.solved if kind(a["ways"]) != "simple")
    assert share.tangle_percent == pytest.approx(100 * tangled / model.n)
    over, size = solver.overlaps(model.blocks())
    assert share.overlap_percent == pytest.approx(100 * over / size)


def test_overlaps_of_tiled_blocks():
    """Two tails on one block, the second from the first's; a block that begins behind the block but within the joined tail is one of its own."""
    inside, a, b, c, far = (2, [1] * 5), (0, [0] * 10), (6, [1] * 8), (9, [0] * 8), (20, [0] * 3)
    assert solver.overlaps([far, b, inside, a]) == (4, 14 + 3)
    assert solver.overlaps([a, b, c]) == (4, 17) and solver.overlaps([a, b, (12, [1] * 6)]) == (4, 14 + 6)
    assert solver.overlaps([]) == (0, 0) and solver.overlaps([a, far]) == (0, 13)


def test_islands_over_buckets(spark, monkeypatch):
    """Islands do not depend on how variants are dealt out over tasks."""
    rows, _ = matrix(7, n=80, holes=(30, 55))
    own = reads.informative_reads(frame(spark, rows))
    want = sorted(map(tuple, reads.coverage_islands(own).collect()))
    monkeypatch.setattr(reads, "BUCKET", 4)
    assert sorted(map(tuple, reads.coverage_islands(own).collect())) == want
