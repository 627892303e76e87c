import functools
import math
import random

from pyspark.sql import functions as F

from strandloom.functions import align, cigar, numbers, text


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text(spark):
    got = one(spark, a=text.split_str(F.lit("x::y:"), ":"), b=text.join_str(F.array(F.lit("p"), F.lit("q")), "|"), c=text.swapped(F.array(F.lit(1), F.lit(2)), F.lit(0), F.lit(1)), d=text.swapped(F.array(F.lit(1)), F.lit(0), F.lit(2)))
    assert (got.a, got.b, got.c, got.d) == (["x", "y"], "p|q", [2, 1], [1])


def test_numbers(spark):
    sizes = spark.range(0, 70).select("id", numbers.roundup_pow2(F.col("id")).alias("p")).collect()
    assert all(r.p == (1 if r.id <= 1 else 1 << (r.id - 1).bit_length()) for r in sizes)
    got = one(spark, s=numbers.logsumexp10(F.lit(-400.0), F.lit(-400.0)), p=numbers.phred_to_prob(F.lit(20.0)), w=numbers.cut_edge_weight(F.lit(0.1), F.lit(0.2), F.lit(1), F.lit(1)))
    assert math.isclose(got.s, -400 + math.log10(2)) and math.isclose(got.p, 0.01) and math.isclose(got.w, math.log10(0.74 / 0.26))


def test_cigar(spark):
    ops = cigar.parse_cigar(F.lit("5H2S10M3I4M2D6M"))
    got = one(spark, c=ops, s=cigar.cigar_spans(ops), n=cigar.cigar_spans(cigar.parse_cigar(F.lit("*"))), **{f"q{p}": cigar.query_pos(ops, F.lit(100), F.lit(p)) for p in (100, 109, 110, 114, 115, 116, 122)}, b=cigar.base_code(F.lit("acgxN")))
    assert [(x.op, x.len) for x in got.c][:2] == [("H", 5), ("S", 2)]
    assert tuple(got.s) == (25, 22) and tuple(got.n) == (0, 0) and got.b == "ACGNN"
    assert [got[f"q{p}"] for p in (100, 109, 110, 114, 115, 116, 122)] == [2, 11, 15, 18, 18, 19, None]


def naive_affine(q, t):
    far = 10**8
    h = [[-far] * (len(t) + 1) for _ in range(len(q) + 1)]
    gap_q = [[-far] * (len(t) + 1) for _ in range(len(q) + 1)]
    gap_t = [[-far] * (len(t) + 1) for _ in range(len(q) + 1)]
    h[0][0] = 0
    for i in range(1, len(q) + 1):
        h[i][0] = gap_t[i][0] = -4 - 2 * i
        for j in range(1, len(t) + 1):
            gap_q[i][j] = max(h[i][j - 1] - 4, gap_q[i][j - 1]) - 2
            gap_t[i][j] = max(h[i - 1][j] - 4, gap_t[i - 1][j]) - 2
            h[i][j] = max(h[i - 1][j - 1] + (2 if q[i - 1] == t[j - 1] else -4), gap_q[i][j], gap_t[i][j])
    return h[-1][-1]


def test_alignments(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("ACGT") for _ in range(rng.randint(1, 12))), "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 12)))) for _ in range(60)]
    df = spark.createDataFrame([*pairs, (None, "A")], "q string, t string")
    got = df.select("q", "t", align.edit_distance_dp("q", "t").alias("d"), align.affine_gap_score("q", "t").alias("a")).collect()
    for r in got:
        assert (r.d is None) == (r.q is None) and (r.q is None or r.a == naive_affine(r.q, r.t))
    places = df.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(11)))).select("q", "t", "p", align.align_traceback("q", "t", "p").alias("x"), F.levenshtein("q", "t").alias("d"))
    for r in places.collect():
        assert tuple(r.x) == ((None, None) if r.q is None else (r.d, naive_base(r.q, r.t, r.p)))
    traced = spark.createDataFrame([("ACGT", "ACGT", 2), ("ACT", "ACGT", 2), ("ATGT", "ACGT", 1), ("", "", 0), ("A", "C", None)], "q string, t string, p long").select(align.align_traceback("q", "t", "p").alias("x")).collect()
    assert [tuple(r.x) for r in traced] == [(0, "G"), (1, "-"), (1, "T"), (0, "-"), (None, None)]


def naive_base(q, t, place):
    """The base at a place of the target, by the best alignment that ends with a pair rather than a gap in the query, and that rather than one in the target."""
    @functools.cache
    def best(i, j):
        if not i or not j:
            return i + j
        return min(best(i - 1, j - 1) + (q[i - 1] != t[j - 1]), best(i, j - 1) + 1, best(i - 1, j) + 1)

    i, j = len(q), len(t)
    while i or j:
        if i and j and best(i, j) == best(i - 1, j - 1) + (q[i - 1] != t[j - 1]):
            if j - 1 == place:
                return q[i - 1]
            i, j = i - 1, j - 1
        elif j and best(i, j) == best(i, j - 1) + 1:
            j -= 1
        else:
            i -= 1
    return "-"


def test_shown_alignment(spark):
    rows = [("ACT", "ACGT"), ("", ""), (None, "A"), ("TT", ""), ("GATTACA", "GCATGCT")]
    got = [r.x for r in spark.createDataFrame(rows, "q string, t string").select(align.show_alignment("q", "t").alias("x")).collect()]
    assert got[:4] == ["ACGT\n|| |\nAC-T", "\n\n", None, "--\n  \nTT"]
    target, marks, query = got[4].split("\n")
    assert target.replace("-", "") == "GCATGCT" and query.replace("-", "") == "GATTACA"
    assert len(marks) - marks.count("|") == 4 and all((a == b) == (c == "|") for a, b, c in zip(target, query, marks))
