"""All registered queries of the phasing engine with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import file_catalog
from strandloom.operators import blocks, bubbles, contraction, cut, hints, kmers, linear, reads, solver, walks
from strandloom.operators.stored import stored
from strandloom.plans import derived, phasing
from strandloom.plans.derived import MATRIX_SQL
from strandloom.sources import vcf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def register(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            ORACLES[key] = sql
        return function

    return register


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.informative_reads(derived.alleles(spark, sf_dir))


# Common table expressions of the SQL side. They use joins and correlated
# conditions where the engine uses windows.
_TRIM = """
ends AS (SELECT chrom, rid, min(snp_idx) AS lo, max(snp_idx) AS hi FROM m WHERE allele >= 0 GROUP BY ALL),
t AS (SELECT m.* FROM m JOIN ends USING (chrom, rid) WHERE snp_idx BETWEEN lo AND hi)"""
_READS = _TRIM + """,
a AS (SELECT t.* FROM t JOIN (SELECT chrom, rid FROM t GROUP BY ALL HAVING count(*) >= 2) USING (chrom, rid)),
span AS (SELECT chrom, rid, min(snp_idx) AS first, max(snp_idx) AS last FROM a GROUP BY ALL),
size AS (SELECT chrom, max(snp_idx) + 1 AS n_snp FROM a GROUP BY ALL)"""
_PAIRS = """
pair AS (SELECT x.chrom, x.snp_idx AS s, count(*) FILTER (WHERE x.allele = y.allele) AS same,
           count(*) FILTER (WHERE x.allele <> y.allele) AS diff
         FROM a x JOIN a y ON x.chrom = y.chrom AND x.rid = y.rid AND y.snp_idx = x.snp_idx + 1
         WHERE x.allele >= 0 AND y.allele >= 0 GROUP BY ALL)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join([MATRIX_SQL, *parts])


def _words_sql(name: str, n: int) -> str:
    """Windows of n calls by n-fold self-join, with their complements."""
    joins = " ".join(f"JOIN a a{j} ON a{j}.chrom = a0.chrom AND a{j}.rid = a0.rid AND a{j}.snp_idx = a0.snp_idx + {j} AND a{j}.allele >= 0" for j in range(1, n))
    word = " + ".join(f"a{j}.allele * {1 << (n - 1 - j)}" for j in range(n))
    return f"""
{name}_half AS (SELECT a0.chrom, a0.snp_idx AS s, ({word})::BIGINT AS w FROM a a0 {joins} WHERE a0.allele >= 0),
{name} AS (SELECT chrom, s, w, count(*) AS cnt FROM
  (SELECT * FROM {name}_half UNION ALL SELECT chrom, s, {(1 << n) - 1} - w FROM {name}_half) GROUP BY ALL)"""


def _graph_sql(k: int) -> str:
    mask, full = (1 << k) - 1, (1 << (k + 1)) - 1
    return ",".join([_READS, _words_sql("node", k), _words_sql("edge", k + 1), f"""
made AS (
  SELECT u.chrom, u.s, u.w * 2 + v.w % 2 AS e, (u.cnt + v.cnt) // 2 AS weight,
    row_number() OVER (PARTITION BY u.chrom, u.s ORDER BY (u.cnt + v.cnt) // 2 DESC, u.w * 2 + v.w % 2) AS rank
  FROM node u JOIN node v ON v.chrom = u.chrom AND v.s = u.s + 1 AND u.w % {1 << (k - 1)} = v.w // 2
  WHERE NOT EXISTS (SELECT 1 FROM edge WHERE edge.chrom = u.chrom AND edge.s = u.s)),
patched AS (
  SELECT chrom, s, w AS e, cnt AS weight FROM edge
  UNION ALL SELECT chrom, s, e, weight FROM made WHERE rank = 1
  UNION ALL SELECT chrom, s, {full} - e, weight FROM made WHERE rank = 1),
heavy AS (SELECT chrom, s, max(weight) AS most FROM patched GROUP BY ALL),
live AS (SELECT p.* FROM patched p JOIN heavy USING (chrom, s)
  WHERE CASE WHEN most >= 15 THEN weight * 2 >= most ELSE weight * 5 >= most END),
ends_of AS (SELECT chrom, s, e // 2 AS w FROM live UNION SELECT chrom, s + 1, e & {mask} FROM live)"""])


# Reads.


@_query(_with(_TRIM) + " SELECT chrom, rid, snp_idx, allele FROM t")
def gap_trim(spark, sf_dir):
    return reads.gap_trim(derived.alleles(spark, sf_dir))


@_query(_with(_READS) + " SELECT chrom, rid, snp_idx, allele FROM a")
def informative_reads(spark, sf_dir):
    return _reads(spark, sf_dir)


@_query(_with(_READS) + " SELECT chrom, count(*) FILTER (WHERE allele >= 0) AS alleles, count(*) AS calls, count(DISTINCT rid) AS reads FROM a GROUP BY chrom")
def allele_totals(spark, sf_dir):
    return reads.allele_totals(_reads(spark, sf_dir))


@_query(_with(_READS) + """,
seen AS (SELECT DISTINCT chrom, snp_idx FROM a),
tied AS (SELECT DISTINCT x.chrom, x.snp_idx FROM a x JOIN a y ON x.chrom = y.chrom AND x.rid = y.rid AND y.snp_idx = x.snp_idx + 1),
begun AS (SELECT chrom, snp_idx FROM seen WHERE NOT EXISTS
  (SELECT 1 FROM tied WHERE tied.chrom = seen.chrom AND tied.snp_idx = seen.snp_idx - 1))
SELECT s.chrom, s.snp_idx, b.snp_idx AS island FROM seen s ASOF JOIN begun b ON s.chrom = b.chrom AND s.snp_idx >= b.snp_idx""")
def coverage_islands(spark, sf_dir):
    return reads.coverage_islands(_reads(spark, sf_dir))


@_query(_with(_READS) + " SELECT x.chrom, y.snp_idx, x.rid FROM a x JOIN a y ON x.chrom = y.chrom AND x.rid = y.rid AND y.snp_idx = x.snp_idx + 1")
def adjacent_snp_read_intersect(spark, sf_dir):
    return reads.adjacent_reads(_reads(spark, sf_dir))


@_query(_with(_READS) + """, point AS (SELECT DISTINCT chrom, snp_idx FROM a)
SELECT span.chrom, span.rid, point.snp_idx AS pos FROM span JOIN point
  ON span.chrom = point.chrom AND point.snp_idx BETWEEN span.first AND span.last""")
def read_snp_overlap(spark, sf_dir):
    own = _reads(spark, sf_dir)
    spans = reads.read_spans(own).select("chrom", "rid", F.col("first").alias("start"), (F.col("last") + 1).alias("end"))
    points = own.select("chrom", F.col("snp_idx").alias("pos")).distinct()
    return reads.bin_overlap(spans, points, 64).select("chrom", "rid", "pos")


# The graph.


@_query(_with(_READS, _PAIRS) + " SELECT chrom, s, same, diff FROM pair")
def pair_counts(spark, sf_dir):
    return kmers.pair_counts(_reads(spark, sf_dir))


def _register_graph(k: int) -> None:
    tail = "" if k == 2 else f"_k{k}"
    base = _with(_graph_sql(k))
    mask = (1 << k) - 1

    def at(f):
        return lambda spark, sf_dir: f(_reads(spark, sf_dir))

    def patched(own):
        return kmers.patched_graph(own, k)[1]

    def trimmed(own):
        return kmers.edge_trim(patched(own))

    for name, run, sql in (
        ("kmer_nodes", lambda own: kmers.kmer_nodes(own, k), "SELECT chrom, s, w, cnt FROM node"),
        ("kmer_edges", lambda own: kmers.kmer_edges(own, k), "SELECT chrom, s, w AS e, cnt FROM edge"),
        ("edge_patch", patched, "SELECT chrom, s, e, weight FROM patched"),
        ("edge_trim", trimmed, "SELECT chrom, s, e, weight FROM live"),
        ("isolated_node_reset", lambda own: kmers.graph(own, k)[0], "SELECT chrom, s, w, cnt FROM node SEMI JOIN ends_of USING (chrom, s, w)"),
        ("out_degree", lambda own: kmers.degrees(trimmed(own), k, True), "SELECT chrom, s, e // 2 AS w, count(*) AS degree FROM live GROUP BY ALL"),
        ("in_degree", lambda own: kmers.degrees(trimmed(own), k, False), f"SELECT chrom, s + 1 AS s, e & {mask} AS w, count(*) AS degree FROM live GROUP BY ALL"),
        ("edge_endpoint_join", lambda own: kmers.endpoints(kmers.kmer_edges(own, k), kmers.kmer_nodes(own, k), k).select("chrom", "s", "e", "u", "v", "cnt", "cnt_u", "cnt_v"),
         f"SELECT e.chrom, e.s, e.w AS e, e.w // 2 AS u, e.w & {mask} AS v, e.cnt, u.cnt AS cnt_u, v.cnt AS cnt_v FROM edge e, node u, node v WHERE u.chrom = e.chrom AND u.s = e.s AND u.w = e.w // 2 AND v.chrom = e.chrom AND v.s = e.s + 1 AND v.w = e.w & {mask}"),
        ("graph_stats", lambda own: kmers.graph_stats(*kmers.graph(own, k)), "SELECT chrom, (SELECT count(*) FROM ends_of x WHERE x.chrom = live.chrom) AS n_nodes, count(*) AS n_edges FROM live GROUP BY chrom"),
        ("symmetry_check", lambda own: kmers.symmetry_check(trimmed(own), k).select("chrom", "s", "e"),
         f"SELECT l.chrom, l.s, l.e FROM live l WHERE l.e < {1 << k} AND NOT EXISTS (SELECT 1 FROM live r WHERE r.chrom = l.chrom AND r.s = l.s AND r.e = {2 * mask + 1} - l.e AND r.weight = l.weight)"),
        ("ambiguous_pairs", lambda own: bubbles.ambiguous_pairs(trimmed(own), k),
         "SELECT chrom, snp_idx FROM (" + " UNION ".join(f"SELECT chrom, s + {j} AS snp_idx, (e >> {k - j}) % 2 = (e >> {k - j + 1}) % 2 AS equal FROM live WHERE e <= {mask}" for j in range(1, k + 1)) + ") GROUP BY ALL HAVING count(DISTINCT equal) = 2"),
    ):
        _query(f"{base} {sql}", name + tail)(at(run))


for _k in (2, 3, 4, 5):
    _register_graph(_k)

_AMBIGUOUS = ORACLES["ambiguous_pairs"].replace("SELECT chrom, snp_idx FROM (", ", amb AS (SELECT chrom, snp_idx FROM (", 1) + "),"
_SEGMENTS = _AMBIGUOUS + """
bound AS (
  SELECT y.chrom, y.snp_idx, min(span.first) AS l_bound, max(span.last) AS r_bound
  FROM a x JOIN a y ON x.chrom = y.chrom AND x.rid = y.rid AND y.snp_idx = x.snp_idx + 1
  JOIN amb ON amb.chrom = y.chrom AND amb.snp_idx = y.snp_idx
  JOIN span ON span.chrom = x.chrom AND span.rid = x.rid GROUP BY ALL)"""


@_query(_SEGMENTS + " SELECT chrom, snp_idx, l_bound, r_bound FROM bound")
def bubble_bounds(spark, sf_dir):
    own = stored(_reads(spark, sf_dir))
    return bubbles.bubble_bounds(bubbles.ambiguous_pairs(kmers.graph(own, 2)[1], 2), own)


@_query(_SEGMENTS + """,
cut AS (SELECT b.chrom, b.snp_idx, b.l_bound > (SELECT max(p.snp_idx) FROM bound p WHERE p.chrom = b.chrom AND p.snp_idx < b.snp_idx) AS is_new FROM bound b),
named AS (SELECT b.*, (SELECT count(*) FROM cut WHERE cut.chrom = b.chrom AND cut.snp_idx <= b.snp_idx AND is_new) AS bubble FROM bound b)
SELECT chrom, bubble, min(l_bound) AS l_bound, max(r_bound) AS r_bound, count(*) AS n_pairs FROM named GROUP BY ALL""")
def bubble_segments(spark, sf_dir):
    return bubbles.bubble_segments(bubble_bounds(spark, sf_dir))


# Hints.

_EVERY = """
every AS (SELECT size.chrom, g.s, coalesce(same + diff, 0) AS total, coalesce(abs(same - diff), 0) AS gap
  FROM size, LATERAL (SELECT unnest(range(0, n_snp - 1)) AS s) g LEFT JOIN pair ON pair.chrom = size.chrom AND pair.s = g.s)"""
_LIMIT = """
counted AS (SELECT d.d, e.chrom, count(*) FILTER (WHERE total < 5) + count(*) FILTER (WHERE gap <= d.d) AS n FROM every e, (SELECT unnest(range(6, 20)) AS d) d GROUP BY ALL),
limits AS (SELECT size.chrom, coalesce((SELECT max(d) FROM counted c WHERE c.chrom = size.chrom AND c.n < 0.05 * n_snp), 5) AS threshold FROM size)"""


def _pairs_and_sizes(spark, sf_dir):
    own = stored(_reads(spark, sf_dir))
    return stored(kmers.pair_counts(own)), reads.variant_counts(own)


@_query(_with(_READS, _PAIRS, _EVERY) + " SELECT chrom, s AS snp_idx FROM every WHERE total < 5 UNION SELECT chrom, s + 1 FROM every WHERE total < 5")
def low_depth_hint(spark, sf_dir):
    return hints.low_depth_hint(*_pairs_and_sizes(spark, sf_dir))


@_query(_with(_READS, _PAIRS, _EVERY, _LIMIT) + " SELECT chrom, threshold FROM limits")
def diff_threshold(spark, sf_dir):
    return hints.diff_threshold(*_pairs_and_sizes(spark, sf_dir))


@_query(_with(_READS, _PAIRS, _EVERY, _LIMIT) + """, low AS (SELECT chrom, s FROM every JOIN limits USING (chrom) WHERE gap < threshold)
SELECT chrom, s AS snp_idx FROM low UNION SELECT chrom, s + 1 FROM low""")
def low_diff_hint(spark, sf_dir):
    return hints.low_diff_hint(*_pairs_and_sizes(spark, sf_dir))


@_query(_with(_READS, _PAIRS, _EVERY) + """ SELECT e.chrom, g.gap, count(*) FILTER (WHERE e.gap <= g.gap) AS up_to
FROM every e, (SELECT unnest(range(0, 20)) AS gap) g GROUP BY ALL""")
def cumulative_hist(spark, sf_dir):
    return hints.cumulative(*_pairs_and_sizes(spark, sf_dir))


# Blocks.

_BLOCKS = """
seen AS (SELECT DISTINCT chrom, snp_idx FROM a),
step AS (SELECT seen.chrom, seen.snp_idx, coalesce(same = diff, true) AS tie, (diff > same)::INTEGER AS turn
  FROM seen LEFT JOIN pair ON pair.chrom = seen.chrom AND pair.s = seen.snp_idx - 1),
blk AS (SELECT s.chrom, b.snp_idx AS block, s.snp_idx, s.tie, s.turn
  FROM step s ASOF JOIN (SELECT chrom, snp_idx FROM step WHERE tie) b ON s.chrom = b.chrom AND s.snp_idx >= b.snp_idx),
phased AS (SELECT x.chrom, x.block, x.snp_idx, (coalesce(sum(y.turn) FILTER (WHERE NOT y.tie), 0) % 2)::INTEGER AS phase
  FROM blk x JOIN blk y ON x.chrom = y.chrom AND x.block = y.block AND y.snp_idx <= x.snp_idx GROUP BY ALL),
bounds AS (SELECT chrom, block, min(snp_idx) AS lo, max(snp_idx) AS hi FROM phased GROUP BY ALL)"""
_MAJORITY = _with(_READS, _PAIRS, _BLOCKS)


def _majority(spark, sf_dir):
    own = stored(_reads(spark, sf_dir))
    return own, stored(blocks.majority_blocks(own, kmers.pair_counts(own)))


@_query(_MAJORITY + " SELECT chrom, block, snp_idx, phase FROM phased")
def majority_blocks(spark, sf_dir):
    return _majority(spark, sf_dir)[1]


@_query(_with(_READS) + """ SELECT x.chrom, x.rid AS block, x.first AS first_snp, x.last AS last_snp FROM span x WHERE NOT EXISTS
(SELECT 1 FROM span y WHERE y.chrom = x.chrom AND y.first <= x.first AND y.last >= x.last
  AND (y.first < x.first OR y.last > x.last OR y.rid < x.rid))""")
def shadow_blocks(spark, sf_dir):
    spans = reads.read_spans(_reads(spark, sf_dir))
    return blocks.shadow_blocks(spans.select("chrom", F.col("rid").alias("block"), F.col("first").alias("first_snp"), F.col("last").alias("last_snp")))


def _delta_sql(turned: str) -> str:
    return _MAJORITY + f""",
own AS (SELECT a.chrom, b.block, a.rid, a.snp_idx, (a.allele <> p.phase)::BIGINT AS wrong, a.allele >= 0 AS called
  FROM a JOIN span USING (chrom, rid) JOIN bounds b ON b.chrom = a.chrom AND b.lo <= span.first AND span.last <= b.hi
  JOIN phased p ON p.chrom = a.chrom AND p.block = b.block AND p.snp_idx = a.snp_idx),
each AS (SELECT x.chrom, x.block, x.snp_idx AS "pivot", x.rid, count(*) FILTER (WHERE y.called) AS n,
    coalesce(sum(y.wrong) FILTER (WHERE y.called), 0) AS old,
    coalesce(sum(CASE WHEN {turned} THEN 1 - y.wrong ELSE y.wrong END) FILTER (WHERE y.called), 0) AS new
  FROM own x JOIN own y ON x.chrom = y.chrom AND x.block = y.block AND x.rid = y.rid GROUP BY ALL)
SELECT chrom, block, "pivot", sum(least(old, n - old))::BIGINT AS old_mec, sum(least(new, n - new))::BIGINT AS new_mec FROM each GROUP BY ALL"""


@_query(_delta_sql("y.snp_idx > x.snp_idx"))
def mec_switch_delta(spark, sf_dir):
    return blocks.mec_switch_delta(*_majority(spark, sf_dir))


@_query(_delta_sql("y.snp_idx = x.snp_idx"))
def mec_flip_delta(spark, sf_dir):
    return blocks.mec_flip_delta(*_majority(spark, sf_dir))


_CONNECT = _MAJORITY + """,
near AS (SELECT b.chrom, p.block AS before, p.lo AS p_lo, p.hi AS p_hi, b.block, b.lo AS c_lo, b.hi AS c_hi
  FROM bounds b ASOF JOIN bounds p ON p.chrom = b.chrom AND b.lo > p.lo),
crossing AS (SELECT near.*, span.rid FROM near JOIN span ON span.chrom = near.chrom
  AND span.first BETWEEN p_lo AND p_hi AND span.last BETWEEN c_lo AND c_hi),
hit AS (SELECT c.chrom, c.before, c.block, c.rid, count(p.phase) AS nl, count(q.phase) AS nr,
    count(*) FILTER (WHERE a.allele = p.phase) AS l, count(*) FILTER (WHERE a.allele = q.phase) AS r
  FROM crossing c JOIN a ON a.chrom = c.chrom AND a.rid = c.rid AND a.allele >= 0
  LEFT JOIN phased p ON p.chrom = c.chrom AND p.block = c.before AND p.snp_idx = a.snp_idx
  LEFT JOIN phased q ON q.chrom = c.chrom AND q.block = c.block AND q.snp_idx = a.snp_idx
  GROUP BY ALL HAVING nl > 0 AND nr > 0),
total AS (SELECT chrom, block, sum(least(l + r, nl + nr - l - r))::BIGINT AS kept_mec,
    sum(least(l + nr - r, nl - l + r))::BIGINT AS reverse_mec FROM hit GROUP BY ALL),
joined AS (SELECT near.chrom, near.block, near.before, coalesce(kept_mec, 0) AS kept_mec, coalesce(reverse_mec, 0) AS reverse_mec,
    CASE WHEN kept_mec > reverse_mec THEN 1 WHEN kept_mec < reverse_mec THEN 0 ELSE -1 END AS state
  FROM near LEFT JOIN total USING (chrom, block))"""


@_query(_CONNECT + " SELECT chrom, block, before, kept_mec, reverse_mec, state FROM joined")
def block_connect_mec(spark, sf_dir):
    return blocks.block_connect(*_majority(spark, sf_dir))


@_query(_CONNECT + """,
state AS (SELECT b.chrom, b.block, coalesce(j.state, -1) AS state FROM bounds b LEFT JOIN joined j ON j.chrom = b.chrom AND j.block = b.block),
grp AS (SELECT s.chrom, s.block, g.block AS "group" FROM state s ASOF JOIN (SELECT * FROM state WHERE state = -1) g ON g.chrom = s.chrom AND s.block >= g.block)
SELECT g.chrom, g.block, g."group", (count(*) FILTER (WHERE s.state = 1) % 2)::INTEGER AS turned
FROM grp g JOIN state s ON s.chrom = g.chrom AND s.block BETWEEN g."group" AND g.block GROUP BY ALL""")
def block_merge(spark, sf_dir):
    own, made = _majority(spark, sf_dir)
    return blocks.block_merge(made, blocks.block_connect(own, made))


def _auto_sql() -> str:
    """Reads as lists; a word of K calls is usable without a gap, and so is the edge that ends with it, a gap before it read as 0."""
    each = " UNION ALL ".join(f"""
SELECT size.chrom, {k} AS k, n_snp - {k} AS ranks,
  (SELECT sum(len(x) - {k} + 1) FROM l WHERE l.chrom = size.chrom AND len(x) >= {k}) AS words,
  (SELECT count(*) FROM w WHERE w.chrom = size.chrom AND list_min(list_slice(x, i - {k - 1}, i)) >= 0 AND i >= {k}) AS usable,
  (SELECT count(DISTINCT (first + i - {k + 1}, list_transform(list_slice(x, i - {k}, i), lambda c: c = 1))) FROM w WHERE w.chrom = size.chrom AND list_min(list_slice(x, i - {k - 1}, i)) >= 0 AND i > {k}) AS edges,
  (SELECT count(DISTINCT first + i - {k + 1}) FROM w WHERE w.chrom = size.chrom AND list_min(list_slice(x, i - {k - 1}, i)) >= 0 AND i > {k}) AS joined
FROM size""" for k in (2, 3, 4, 5))
    return _with(_READS, f"""
l AS (SELECT chrom, rid, min(snp_idx) AS first, list(allele ORDER BY snp_idx) AS x FROM a GROUP BY ALL),
w AS (SELECT chrom, first, x, unnest(range(1, len(x) + 1)) AS i FROM l),
measured AS ({each}),
scored AS (SELECT chrom, k, usable::DOUBLE / words - edges::DOUBLE / ((2 << k) * ranks) AS over, (ranks - joined)::DOUBLE / ranks AS apart FROM measured),
final AS (SELECT chrom, k, CASE WHEN apart <> 0 THEN 100 * over / (5 * apart) WHEN over > 0 THEN 'Infinity'::DOUBLE WHEN over < 0 THEN '-Infinity'::DOUBLE END AS score FROM scored)""") + """
SELECT chrom, k, round(score, 6) AS score, k = coalesce((SELECT arg_min(o.k, (-o.score, o.k)) FROM final o WHERE o.chrom = f.chrom AND o.score > 0), 2) AS chosen FROM final f"""


@_query(_auto_sql())
def auto_k(spark, sf_dir):
    return kmers.auto_k(_reads(spark, sf_dir)).withColumn("score", F.round("score", 6))


# The order-dependent passes and the whole; beyond SQL, held against models in the tests.


def _register_solver(k: int) -> None:
    tail = "" if k == 2 else f"_k{k}"
    for name, stage in (("tip_removal", "tips"), ("bubble_solve", "bubbles"), ("error_correction", "corrected")):
        _query(name=name + tail)(lambda spark, sf_dir, stage=stage: solver.solve(stored(_reads(spark, sf_dir)), k, stage))
    _query(name="haplotype_blocks" + tail)(lambda spark, sf_dir: walks.haplotype_walks(solver.solve(stored(_reads(spark, sf_dir)), k, "bubbles"), k))
    _query(name="phase_end_to_end" + tail)(lambda spark, sf_dir: phasing.phase(derived.alleles(spark, sf_dir), k))


for _k in phasing.ALLOWED_K:
    _register_solver(_k)


# Bubbles between linear flanks: the flanks in SQL, step by step; what is solved on them is held against a model in the tests.


def _flanks_sql(k: int) -> str:
    mask = (1 << k) - 1
    return _with(_graph_sql(k), f"""
alone AS (
  SELECT chrom, s, e // 2 AS u, e & {mask} AS v, count(*) OVER (PARTITION BY chrom, s, e // 2) AS n_out, count(*) OVER (PARTITION BY chrom, s, e & {mask}) AS n_in FROM live),
edge1 AS (SELECT chrom, s, u, v FROM alone WHERE n_out = 1 AND n_in = 1),
walk AS (
  SELECT 0 AS side, chrom, s + 1 AS s, v AS w, s AS pos, u AS node, 1 AS length, (u >> {k - 1})::VARCHAR AS path FROM edge1
  UNION ALL SELECT 1, chrom, s, u, s + 1, v, 1, (v & 1)::VARCHAR FROM edge1
  UNION ALL SELECT side, w.chrom, w.s, w.w, CASE side WHEN 0 THEN w.pos - 1 ELSE w.pos + 1 END, CASE side WHEN 0 THEN e.u ELSE e.v END, length + 1,
    CASE side WHEN 0 THEN (e.u >> {k - 1})::VARCHAR || path ELSE path || (e.v & 1)::VARCHAR END
  FROM walk w JOIN edge1 e ON e.chrom = w.chrom AND CASE side WHEN 0 THEN e.s = w.pos - 1 AND e.v = w.node ELSE e.s = w.pos AND e.u = w.node END WHERE length < 64)""").replace("WITH", "WITH RECURSIVE", 1) + """
SELECT side, chrom, s, w, max(length) AS length, arg_max(path, length) AS path FROM walk GROUP BY ALL"""


def _register_linear(k: int) -> None:
    tail = "" if k == 2 else f"_k{k}"
    _query(_flanks_sql(k), "linear_flanks" + tail)(lambda spark, sf_dir: linear.flanks(stored(kmers.edge_trim(kmers.patched_graph(_reads(spark, sf_dir), k)[1])), k))

    def solved(spark, sf_dir):
        own = stored(_reads(spark, sf_dir))
        return own, *linear.topology_bubbles(own, solver.solve(own, k, "tips"), k)

    _query(name="topology_bubble" + tail)(lambda spark, sf_dir: solved(spark, sf_dir)[2])
    _query(name="topology_graph" + tail)(lambda spark, sf_dir: solved(spark, sf_dir)[1])

    def errors(spark, sf_dir):
        own = stored(_reads(spark, sf_dir))
        both = stored(solver.solve_stages(own, k, ("tips", "blocks")))
        _, found = linear.topology_bubbles(own, solver.edges_of(both, "tips"), k)
        return linear.default_errors(found, own, solver.blocks_of(both, "blocks"))

    _query(name="topology_errors" + tail)(errors)


for _k in (2, 3):
    _register_linear(_k)


@_query(name="bubble_classify")
def bubble_classify(spark, sf_dir):
    return solver.areas_of(solver.solve_stages(stored(_reads(spark, sf_dir)), 2, ("areas",)))


@_query(name="log_shares")
def log_shares(spark, sf_dir):
    own = stored(_reads(spark, sf_dir))
    return solver.shares_of(solver.solve_stages(own, 2, ("shares",)), reads.variant_counts(own))


# Scalar functions and alternates.

_STRINGS_SQL = """WITH w AS (SELECT l_orderkey AS id, l_linenumber AS line, substr(translate(md5(l_orderkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 31) AS q,
  substr(translate(md5((l_orderkey + l_partkey % 2)::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 31) AS r FROM lineitem),
v AS (SELECT *, substr(r, 1, 15) || 'A' || substr(r, 17) AS a FROM w)"""


def _strings(spark, sf_dir):
    dna = lambda c: F.substring(F.translate(F.md5(c.cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 31)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), dna(F.col("l_orderkey")).alias("q"), dna(F.col("l_orderkey") + F.col("l_partkey") % 2).alias("r"))
    return rows.withColumn("a", F.concat(F.substring("r", 1, 15), F.lit("A"), F.expr("substring(r, 17)")))


@_query(_STRINGS_SQL + " SELECT id, line, levenshtein(q, r) AS to_ref, levenshtein(q, a) AS to_alt FROM v")
def edit_distance_pair(spark, sf_dir):
    from strandloom.functions.align import edit_distance_pair as pair

    return _strings(spark, sf_dir).select("id", "line", pair(F.col("q"), F.col("r"), F.col("a")).alias("d")).select("id", "line", "d.*")


@_query(_STRINGS_SQL + " SELECT id, line, CASE WHEN levenshtein(q, r) < levenshtein(q, a) THEN 0 WHEN levenshtein(q, r) > levenshtein(q, a) THEN 1 ELSE -1 END AS allele FROM v")
def allele_call(spark, sf_dir):
    from strandloom.functions.cigar import allele_call as call

    return _strings(spark, sf_dir).select("id", "line", call(F.levenshtein("q", "r"), F.levenshtein("q", "a")).alias("allele"))


@_query("SELECT l_orderkey AS id, l_linenumber AS line, list_filter(string_split(concat_ws('/', l_linenumber % 2, '', l_partkey, ''), '/'), lambda x: x <> '')[2] AS second FROM lineitem")
def split_str(spark, sf_dir):
    from strandloom.functions.text import split_str as split

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = F.concat_ws("/", (F.col("l_linenumber") % 2).cast("string"), F.lit(""), F.col("l_partkey").cast("string"), F.lit(""))
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.get(split(text, "/"), F.lit(1)).alias("second"))


@_query(_with(_READS) + """, p AS (SELECT chrom, rid, (rid * 7919) % 100003 AS pos FROM span)
SELECT x.chrom, x.rid, x.pos, (SELECT count(*) FROM p y WHERE y.chrom = x.chrom AND (y.pos < x.pos OR y.pos = x.pos AND y.rid < x.rid)) AS snp_idx FROM p x""")
def snp_index(spark, sf_dir):
    return vcf.snp_index(reads.read_spans(_reads(spark, sf_dir)).select("chrom", "rid", ((F.col("rid") * 7919) % 100003).alias("pos")), "rid")


@_query(_with(_READS) + """, v AS (SELECT DISTINCT chrom, snp_idx * 10 AS pos, snp_idx FROM a), q AS (SELECT DISTINCT chrom, snp_idx * 10 + 3 AS point FROM a)
SELECT q.chrom, q.point, coalesce((SELECT min(v.snp_idx) FROM v WHERE v.chrom = q.chrom AND v.pos >= q.point), -1) AS snp_idx FROM q""")
def snp_lower_bound(spark, sf_dir):
    own = _reads(spark, sf_dir).select("chrom", "snp_idx").distinct()
    return cut.snp_lower_bound(own.select("chrom", (F.col("snp_idx") * 10 + 3).alias("point")), own.select("chrom", (F.col("snp_idx") * 10).alias("pos"), "snp_idx"))


@_query(_with(_graph_sql(2)) + " SELECT chrom, s, w, s * 4 + w AS node, (w * 2) & 3 AS next_0, (w * 2 + 1) & 3 AS next_1, w // 2 AS previous_0, (4 + w) // 2 AS previous_1, 3 - w AS complement FROM node")
def node_neighbours(spark, sf_dir):
    nodes = kmers.kmer_nodes(_reads(spark, sf_dir), 2)
    s, w, zero, one = F.col("s"), F.col("w"), F.lit(0), F.lit(1)
    return nodes.select("chrom", "s", "w", kmers.node_id(s, w, 2).alias("node"), kmers.next_node(w, zero, 2).alias("next_0"), kmers.next_node(w, one, 2).alias("next_1"), kmers.previous_node(w, zero, 2).alias("previous_0"), kmers.previous_node(w, one, 2).alias("previous_1"), kmers.complement(w, 2).alias("complement"))


@_query(_with(_READS) + " SELECT chrom, rid, min(snp_idx) AS first, string_agg(CASE WHEN allele < 0 THEN '-' ELSE allele::VARCHAR END, '' ORDER BY snp_idx) AS calls FROM a GROUP BY ALL")
def matrix_view(spark, sf_dir):
    return cut.matrix_view(_reads(spark, sf_dir))


@_query(_MAJORITY + """, path AS (SELECT chrom, chrom || '/' || block AS path, snp_idx, phase AS bit FROM phased),
touch AS (SELECT DISTINCT p.path, p.chrom, a.rid FROM path p JOIN a ON a.chrom = p.chrom AND a.snp_idx = p.snp_idx),
called AS (SELECT t.path, t.rid, a.allele, p.bit FROM touch t JOIN a ON a.chrom = t.chrom AND a.rid = t.rid AND a.allele >= 0
  LEFT JOIN path p ON p.path = t.path AND p.snp_idx = a.snp_idx),
one AS (SELECT path, rid, count(*) FILTER (WHERE allele <> bit) AS wrong, count(*) AS n, bool_or(bit IS NULL) AS out FROM called GROUP BY ALL)
SELECT path, (CASE WHEN bool_or(out) THEN -1 ELSE sum(least(wrong, n - wrong)) END)::BIGINT AS mec FROM one GROUP BY path""")
def mec_path(spark, sf_dir):
    own, made = _majority(spark, sf_dir)
    paths = made.select("chrom", F.concat_ws("/", "chrom", F.col("block").cast("string")).alias("path"), "snp_idx", F.col("phase").alias("bit"))
    return cut.mec_path(paths, own)


_FRAGS = _MAJORITY + """,
f0 AS (SELECT chrom, rid AS frag, snp_idx AS variant, allele FROM a WHERE allele >= 0),
fr AS (SELECT f0.*, n FROM f0 JOIN (SELECT chrom, frag, count(*) AS n FROM f0 GROUP BY ALL HAVING n > 1) USING (chrom, frag)),
half AS (SELECT x.chrom, x.frag, x.variant AS u, y.variant AS v, (x.allele = y.allele)::INTEGER AS equal, x.n - 1 AS steps FROM fr x JOIN fr y ON x.chrom = y.chrom AND x.frag = y.frag AND y.variant > x.variant
  AND NOT EXISTS (SELECT 1 FROM fr z WHERE z.chrom = x.chrom AND z.frag = x.frag AND z.variant > x.variant AND z.variant < y.variant)),
ed AS (SELECT * FROM half UNION ALL SELECT chrom, frag, v, u, equal, steps FROM half)"""


@_query(_FRAGS + " SELECT chrom, frag, u, v, equal, steps FROM ed")
def read_variant_graph(spark, sf_dir):
    made = cut.read_variant_graph(cut.fragments(_reads(spark, sf_dir)))
    return made.select("chrom", "frag", "u", "v", "equal", F.round(1 / F.col("share")).cast("long").alias("steps"))


_ODDS = "log10((0.98004737685031118::DOUBLE * 0.98004737685031118 + 0.019952623149688802 * 0.019952623149688802) / (2 * 0.98004737685031118 * 0.019952623149688802))"
_WEIGHTS = _FRAGS + f""",
wt AS (SELECT ed.chrom, u, v, round(sum((CASE WHEN (p.phase = q.phase)::INTEGER = equal THEN 1 ELSE -1 END) * {_ODDS} / steps), 6) AS weight
  FROM ed JOIN phased p ON p.chrom = ed.chrom AND p.snp_idx = u JOIN phased q ON q.chrom = ed.chrom AND q.snp_idx = v GROUP BY ALL)"""


def _weights(spark, sf_dir):
    own, made = _majority(spark, sf_dir)
    return cut.cut_edge_agg(cut.read_variant_graph(cut.fragments(own)), made).withColumn("weight", F.round("weight", 6) + F.lit(0.0))


@_query(_WEIGHTS + " SELECT chrom, u, v, weight + 0.0 AS weight FROM wt")
def cut_edge_agg(spark, sf_dir):
    return _weights(spark, sf_dir)


@_query(_WEIGHTS + " SELECT chrom, u, v, weight FROM wt x QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY round(weight, 5) DESC, u, v) <= least(5, count(*) OVER (PARTITION BY chrom) // 2)")
def topk_cut_edges(spark, sf_dir):
    return cut.topk_cut_edges(_weights(spark, sf_dir)).drop("rank")


@_query(name="max_likelihood_cut")
def max_likelihood_cut(spark, sf_dir):
    own, made = _majority(spark, sf_dir)
    return contraction.max_likelihood_cut(cut.fragments(own), made)


@_query(name="improve_by_cuts")
def improve_by_cuts(spark, sf_dir):
    own, made = _majority(spark, sf_dir)
    return cut.blocks_by_cuts(cut.fragments(own), made)


def _tangle_cut(spark, sf_dir, k=2):
    own = stored(_reads(spark, sf_dir))
    solved = stored(solver.solve_stages(own, k, ("tips", "closed", "areas")))
    pairs = stored(contraction.tangle_pairs(own, solver.edges_of(solved, "tips"), solver.areas_of(solved), k))
    return contraction.tangle_cut(own, solver.edges_of(solved, "closed"), pairs, k)


@_query(name="tangle_cut")
def tangle_cut(spark, sf_dir):
    return _tangle_cut(spark, sf_dir)[0]


@_query(name="tangle_cut_graph")
def tangle_cut_graph(spark, sf_dir):
    return _tangle_cut(spark, sf_dir)[1]


@_query(_FRAGS + """, sc AS (SELECT fr.chrom, frag, count(*) FILTER (WHERE allele = phase) AS hit, count(*) AS n FROM fr JOIN phased p ON p.chrom = fr.chrom AND p.snp_idx = fr.variant GROUP BY ALL),
two AS (SELECT chrom, frag, hit * log10(0.98004737685031118::DOUBLE) + (n - hit) * log10(0.019952623149688802::DOUBLE) AS x, (n - hit) * log10(0.98004737685031118::DOUBLE) + hit * log10(0.019952623149688802::DOUBLE) AS y FROM sc)
SELECT chrom, frag, round(greatest(x, y) + log10(1 + pow(10.0::DOUBLE, -abs(x - y))), 6) AS score FROM two""")
def fragment_score(spark, sf_dir):
    own, made = _majority(spark, sf_dir)
    return cut.fragment_score(cut.fragments(own), made).withColumn("score", F.round("score", 6))


@_query(ORACLES["block_merge"].replace("SELECT g.chrom, g.block, g.\"group\"", ", merged AS (SELECT g.chrom, g.block, g.\"group\"", 1) + """),
ps AS (SELECT m.chrom, m."group", min(p.snp_idx) AS ps_idx FROM merged m JOIN phased p USING (chrom, block) GROUP BY ALL)
SELECT p.chrom, p.snp_idx, ps.ps_idx, xor(p.phase, m.turned) AS phase FROM phased p JOIN merged m USING (chrom, block) JOIN ps ON ps.chrom = m.chrom AND ps."group" = m."group" """)
def phase_assign(spark, sf_dir):
    own, made = _majority(spark, sf_dir)
    return blocks.merged_phases(made, blocks.block_connect(own, made))


def _areas(spark, sf_dir):
    own = stored(_reads(spark, sf_dir))
    pairs = stored(bubbles.ambiguous_pairs(kmers.graph(own, 2)[1], 2))
    return own, pairs, bubbles.bubble_segments(bubbles.bubble_bounds(pairs, own))


@_query(name="tangle_dp")
def tangle_dp(spark, sf_dir):
    own, _, areas = _areas(spark, sf_dir)
    return cut.tangle_dp(own, areas)


@_query(ORACLES["bubble_segments"].replace("SELECT chrom, bubble, min(l_bound)", ", area AS (SELECT chrom, bubble, min(l_bound)", 1) + """),
got AS (SELECT DISTINCT ar.chrom, ar.bubble, a.rid, span.first >= ar.l_bound AND span.last <= ar.r_bound AS within
  FROM area ar JOIN a ON a.chrom = ar.chrom AND a.snp_idx BETWEEN ar.l_bound AND ar.r_bound AND a.allele >= 0
  JOIN amb ON amb.chrom = a.chrom AND amb.snp_idx = a.snp_idx JOIN span ON span.chrom = a.chrom AND span.rid = a.rid)
SELECT chrom, bubble, rid FROM got g WHERE NOT EXISTS (SELECT 1 FROM got o WHERE o.chrom = g.chrom AND o.bubble = g.bubble AND NOT o.within)""")
def bubble_read_collect(spark, sf_dir):
    own, pairs, areas = _areas(spark, sf_dir)
    return cut.bubble_reads(pairs, own, areas)


@_query(ORACLES["bubble_segments"].replace("SELECT chrom, bubble, min(l_bound)", ", area AS (SELECT chrom, bubble, min(l_bound)", 1) + """)
SELECT ar.chrom, ar.bubble, a.rid, CASE WHEN s.first < ar.l_bound THEN '-' ELSE ' ' END || repeat(' ', min(a.snp_idx) - ar.l_bound)
  || string_agg(CASE WHEN a.allele < 0 THEN '-' ELSE a.allele::VARCHAR END, '' ORDER BY a.snp_idx) || CASE WHEN s.last > ar.r_bound THEN '-' ELSE '' END AS row
FROM area ar JOIN a ON a.chrom = ar.chrom AND a.snp_idx BETWEEN ar.l_bound AND ar.r_bound JOIN span s ON s.chrom = a.chrom AND s.rid = a.rid
GROUP BY ar.chrom, ar.bubble, ar.l_bound, ar.r_bound, a.rid, s.first, s.last""")
def bubble_view(spark, sf_dir):
    own, _, areas = _areas(spark, sf_dir)
    return cut.bubble_view(own, areas)


# Shares and neighbours.


@_query(_with(_READS, _PAIRS, _EVERY, _LIMIT) + """, doubtful AS (
  SELECT chrom, unnest([s, s + 1]) AS snp_idx FROM every JOIN limits USING (chrom) WHERE total < 5 OR gap < threshold)
SELECT size.chrom, round(100.0::DOUBLE * (SELECT count(DISTINCT snp_idx) FROM doubtful d WHERE d.chrom = size.chrom) / n_snp, 6) AS percent FROM size""")
def hint_share(spark, sf_dir):
    return hints.hint_share(*_pairs_and_sizes(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@_query(_WEIGHTS + " SELECT chrom, u, string_agg(v::VARCHAR, ',' ORDER BY v) AS neighbours FROM wt GROUP BY ALL")
def sort_adjacency(spark, sf_dir):
    return cut.sorted_adjacency(_weights(spark, sf_dir)).select("chrom", "u", F.array_join(F.transform("edges", lambda e: e["v"].cast("string")), ",").alias("neighbours"))


for _name, (_run, _sql) in file_catalog.registered(_with(_graph_sql(2)), _with(_READS)).items():
    _query(_sql, _name)(_run)
