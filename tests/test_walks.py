"""Blocks by maps of buckets against the plain model, and against the walk within islands."""

import random

import plain_phasing
import pytest
from test_plain_model import per_read
from test_solver import frame, matrix

from strandloom.operators import reads, solver, walks


def blocks(df):
    made = {}
    for r in df.orderBy("snp_idx").collect():
        made.setdefault((r.chrom, r.block), []).append((r.snp_idx, r.phase))
    return sorted((c, b[0][0], [p for _, p in b]) for (c, _), b in made.items())


@pytest.mark.parametrize("k", [2, 3, 4, 5])
@pytest.mark.parametrize("ranks", [1 << 14, 8])
def test_walks_equal_the_plain_rules(spark, k, ranks):
    """Also with buckets of a few ranks, islands that leave buckets empty, and walks that meet."""
    rows, _ = matrix(21 + k, n=120, depth=11, errors=0.09, size=9, holes=(40, 41, 90))
    model = plain_phasing.Chromosome(per_read(rows), k)
    model.remove_tips()
    model.solve_areas()
    own = reads.informative_reads(frame(spark, rows))
    edges = solver.solve(own, k, "bubbles").select("chrom", "s", "e", "weight")
    other = edges.selectExpr("'d' AS chrom", "s + 37 AS s", "e", "weight")
    got = blocks(walks.haplotype_walks(edges.union(other), k, ranks))
    want = model.blocks()
    assert got == sorted([("c", *b) for b in want] + [("d", s + 37, p) for s, p in want])


def test_walks_of_random_maps(spark):
    """Any graph with one way on from each node, against following it step by step."""
    rng = random.Random(8)
    for _ in range(2):
        way = {(s, w): (w << 1 | rng.randint(0, 1)) & 7 for s in range(60) for w in range(8) if rng.random() < 0.85}
        edges = spark.createDataFrame([("c", s, w << 1 | v & 1, 1) for (s, w), v in way.items()], "chrom string, s long, e long, weight long")
        want = []
        reached = {(s + 1, v) for (s, _), v in way.items()}
        for s, w in way:
            if w < 4 and (s, w) not in reached:
                bits, at, now = [w >> 2 & 1, w >> 1 & 1, w & 1], s, w
                while (at, now) in way:
                    at, now = at + 1, way[at, now]
                    bits.append(now & 1)
                want.append(("c", s, bits))
        assert blocks(walks.haplotype_walks(edges, 3, 7)) == sorted(want)
    assert walks.haplotype_walks(edges.filter("false"), 3).count() == 0
