"""Tips, bubbles and corrections in tasks of a few variants each: the results of whole chromosomes, and no task with all of an island."""

import random

import numpy as np
import plain_phasing
import pytest
from pyspark.sql import functions as F
from test_plain_model import per_read
from test_solver import frame, matrix

from strandloom.operators import bubbles, kmers, reads, solver


@pytest.mark.parametrize("k", [2, 4])
def test_passes_do_not_take_an_island_to_a_task(spark, monkeypatch, k):
    rows, _ = matrix(50 + k, n=600, depth=14, errors=0.03, size=5)
    own = reads.informative_reads(frame(spark, rows)).cache()
    monkeypatch.setattr(solver, "TASK", 8)
    model = plain_phasing.Chromosome(per_read(rows), k)
    model.remove_tips()
    tips = dict(model.weight)
    model.solve_areas()
    solved = solver.solve_stages(own, k, ("tips", "bubbles", "hints", "joined")).cache()
    for stage, want in (("tips", tips), ("bubbles", model.weight)):
        assert {(r.s, f"{r.e:0{k + 1}b}"): r.weight for r in solver.edges_of(solved, stage).collect()} == want
    assert {r.at: r.value for r in solved.filter("stage = 'hints'").collect()} == model.hint
    blocks = {}
    for r in solver.blocks_of(solved, "joined").orderBy("snp_idx").collect():
        blocks.setdefault(r.block, []).append(r.phase)
    assert sorted(blocks.items()) == sorted(solver.de_overlap(model.blocks()))


def test_areas_far_apart_share_no_task(spark, monkeypatch):
    """Two undecided places of one island: the task of each holds its own variants only."""
    rows = [("c", 10 * s + r, s + j, (r % 2) if s + j not in (20, 200) else r // 2 % 2) for s in range(236) for r in range(4) for j in range(4)]
    own = reads.informative_reads(frame(spark, rows)).cache()
    assert reads.coverage_islands(own).select("island").distinct().count() == 1
    pairs = bubbles.ambiguous_pairs(kmers.graph(own, 2)[1], 2)
    bounds = bubbles.bubble_bounds(pairs, own).select("chrom", F.col("l_bound").alias("first"), F.col("r_bound").alias("last"))
    found = {}
    for r in solver._tasks(reads.runs(bounds)).collect():
        found.setdefault(r.task, []).append(r.at)
    assert len(found) == 1 and 20 in found[0] and 200 in found[0] and 100 not in found[0]
    monkeypatch.setattr(solver, "TASK", 8)
    assert {r.task for r in solver._tasks(reads.runs(bounds)).collect()} == {r.island // 8 for r in reads.runs(bounds).collect()}


def test_correction_in_pieces_equals_whole_blocks(spark, monkeypatch):
    """Pieces of a few variants that at first read too little beside them, and blocks that overlap; reads of more than 64 variants take whole blocks."""
    rng = random.Random(17)
    rows, truth = matrix(61, n=1500, depth=9, errors=0.1, size=6)
    hint = [rng.random() < 0.7 for _ in truth]
    blocks = [(first, [int(t ^ (rng.random() < 0.12)) for t in truth[first:last]]) for first, last in ((0, 900), (880, 1500), (20, 31))]
    table = spark.createDataFrame([("c", 0, first, first + j, p) for first, b in blocks for j, p in enumerate(b)], "chrom string, island long, block long, snp_idx long, phase int")
    doubtful = spark.createDataFrame([("c", s) for s, h in enumerate(hint) if h], "chrom string, snp_idx long")
    monkeypatch.setattr(solver, "PIECE", 100)
    monkeypatch.setattr(solver, "SLACK", -150)
    largest, tried = solver._corrected, []
    monkeypatch.setattr(solver, "_corrected", lambda *given: tried.append(given[3]) or largest(*given))
    for extra in ([], [("c", 10**6, s, truth[s]) for s in range(400, 480)]):
        given = per_read(rows + extra)
        chosen = []
        for read in given:
            row = [-1] * (read[-1][0] - read[0][0] + 1)
            for s, a in read:
                row[s - read[0][0]] = a
            chosen.append((read[0][0], np.array(row)))
        got = {}
        for r in solver.correct_blocks(frame(spark, rows + extra), table, doubtful).orderBy("snp_idx").collect():
            got.setdefault(r.block, []).append(r.phase)
        for first, b in blocks:
            inside = [(s, r) for s, r in chosen if s >= first and s + len(r) <= first + len(b)]
            assert got[first] == solver.Correction(first, list(b), np.array(hint[first : first + len(b)]), inside).run()
    assert tried[0] == 100 and len(tried) > 2 and tried[-1] is None


def test_only_unsure_pieces_are_done_again(spark, monkeypatch):
    """A piece that reads too little beside it makes neither itself nor the others longer."""
    rng = random.Random(5)
    rows, truth = matrix(62, n=900, depth=9, errors=0.1, size=6)
    phases = [int(t ^ (rng.random() < 0.12)) for t in truth]
    table = spark.createDataFrame([("c", 0, 0, s, p) for s, p in enumerate(phases)], "chrom string, island long, block long, snp_idx long, phase int")
    doubtful = spark.createDataFrame([("c", s) for s in range(len(truth))], "chrom string, snp_idx long")
    monkeypatch.setattr(solver, "PIECE", 100)
    monkeypatch.setattr(solver, "SLACK", -150)
    made, tried = solver._corrected, []

    def corrected(*given):
        out = made(*given).cache()
        tried.append((given[3], {r.piece for r in out.collect()}, {r.piece for r in out.filter("NOT sure").collect()}))
        return out

    monkeypatch.setattr(solver, "_corrected", corrected)
    assert solver.correct_blocks(frame(spark, rows), table, doubtful).count() == len(truth)
    assert len(tried) > 1 and {size for size, _, _ in tried} == {100}
    for (_, _, unsure), (_, again, _) in zip(tried, tried[1:]):
        assert again == unsure
    assert len(tried[1][1]) < len(tried[0][1])
