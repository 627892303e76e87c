"""Bubbles between linear flanks against the plain model of whole chromosomes."""

import plain_phasing
import pytest
from test_plain_model import per_read
from test_solver import frame, matrix

from strandloom import catalog
from strandloom.operators import kmers, linear, reads, solver
from strandloom.plans import derived


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_bubbles_equal_the_plain_rules(spark, k, monkeypatch):
    """Two chromosomes with many bubbles, dead ends, flanks that an earlier bubble takes, and several runs of cells."""
    rows, models = [], {}
    for c, (seed, errors) in enumerate(((1, 0.05), (2, 0.08), (3, 0.12), (4, 0.03))):
        own, _ = matrix(seed + 10 * k, n=700, depth=13, errors=errors, size=14, holes=(333,))
        rows += [(f"c{c}", r, s, a) for _, r, s, a in own]
        models[f"c{c}"] = plain_phasing.Chromosome(per_read(own), k)
        models[f"c{c}"].remove_tips()
    own = reads.informative_reads(frame(spark, rows))
    tips = solver.solve(own, k, "tips").cache()
    for c, model in models.items():
        assert {(r.s, f"{r.e:0{k + 1}b}"): r.weight for r in tips.filter(f"chrom = '{c}'").collect()} == model.weight
    after, found = linear.topology_bubbles(own, tips, k)
    after.cache()
    total = 0
    for c, model in models.items():
        want = model.solve_bubbles_by_shape()
        got = found.filter(f"chrom = '{c}'").orderBy("s", "w").collect()
        assert [(r.s, r.w, r.length, r.ways, r.n_reads, r.mec, r.path) for r in got] == want
        assert {(r.s, f"{r.e:0{k + 1}b}"): r.weight for r in after.filter(f"chrom = '{c}'").collect()} == model.weight
        total += len(want)
    assert total > (20 if k == 2 else 3)
    # Where the default's blocks hold the same reads, its errors are about as many.
    both = linear.default_errors(found, own, solver.solve(own, k, "blocks")).selectExpr("sum(n_inside) AS n", "sum(mec) AS a", "sum(block_mec) AS b").first()
    assert both.n and both.a <= 1.1 * both.b + 5


def test_flanks_by_walking(spark):
    """Doubling gives what walking edge by edge gives, cut at 64 alleles."""
    rows, _ = matrix(5, n=300, depth=20, errors=0.01, size=20, holes=(120,))
    model = plain_phasing.Chromosome(per_read(rows), 2)
    own = reads.informative_reads(frame(spark, rows))
    edges = spark.createDataFrame([("c", s, int(e, 2), w) for (s, e), w in model.weight.items()], "chrom string, s long, e long, weight long")
    got = {(r.side, r.s, f"{r.w:02b}"): r.path for r in linear.flanks(edges, 2).collect()}
    nodes = {x for s, e in model.weight for x in ((s, e[:-1]), (s + 1, e[1:]))}
    want = {(side, *x): model.flank(*x, side == 1)[:: 1 if side else -1] for x in nodes for side in (0, 1)}
    assert got == {x: p for x, p in want.items() if p} and max(map(len, got.values())) == 64
    after, found = linear.topology_bubbles(own, edges.filter("false"), 2)
    assert after.count() == 0 and found.count() == 0


def test_errors_solve_the_graph_once(spark, monkeypatch):
    """The bubbles and the blocks that they are held against come from one run of the passes."""
    sf = "/root/testdata/sf0.001"
    own = reads.informative_reads(derived.alleles(spark, sf)).cache()
    _, found = linear.topology_bubbles(own, solver.solve(own, 2, "tips"), 2)
    want = sorted(map(tuple, linear.default_errors(found, own, solver.solve(own, 2, "blocks")).collect()))
    made, graph = [], kmers.patched_graph
    monkeypatch.setattr(kmers, "patched_graph", lambda *given: made.append(1) or graph(*given))
    assert sorted(map(tuple, catalog.QUERIES["topology_errors"](spark, sf).collect())) == want and want
    assert len(made) == 1


def test_pieces_give_what_one_piece_gives(spark, monkeypatch):
    """Pieces of a few ranks that begin where they end: those that find a bubble's traces from before them are done again."""
    rows, _ = matrix(21, n=700, depth=13, errors=0.05, size=14, holes=(333,))
    own = reads.informative_reads(frame(spark, rows)).cache()
    tips = solver.solve(own, 2, "tips").cache()
    whole = [sorted(map(tuple, df.collect())) for df in linear.topology_bubbles(own, tips, 2)]
    made, pieces = [], linear._pieces
    monkeypatch.setattr(linear, "_pieces", lambda *given: made.append(given[5]) or pieces(*given))
    monkeypatch.setattr(linear, "PIECE", 100)
    monkeypatch.setattr(linear, "LEAD", 4)
    parts = [sorted(map(tuple, df.collect())) for df in linear.topology_bubbles(own, tips, 2)]
    assert parts == whole and len(whole[1]) > 5
    assert made[:2] == [4, 16]
