"""Registered queries of file sources and sinks: files are written from the order tables, read back, and held against SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.align import edit_distance_dp
from strandloom.functions.cigar import base_code, cigar_spans, query_pos
from strandloom.functions.numbers import roundup_pow2
from strandloom.functions.text import join_str
from strandloom.operators import calls, cut, kmers
from strandloom.operators.stored import new_path
from strandloom.plans import derived
from strandloom.sources import alignments, alleles, fasta, vcf
from strandloom.sources.ordered import lines, numbered

BASES = "ACGT"
HEADER = ("##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "##contig=<ID=c0,note=a=b>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS")


def _written(spark: SparkSession, rows: DataFrame, *order: str) -> str:
    """rows.value as lines in order; the file's path."""
    path = new_path(spark)
    rows.orderBy(*order).select("value").write.text(path)
    return path


# Variants: a line for each variant of the matrix, every eleventh with two bases, in a mixed order.


def _vcf(spark: SparkSession, sf_dir: str) -> str:
    rows = derived.alleles(spark, sf_dir).select("chrom", F.col("snp_idx").alias("i")).distinct()
    base = lambda c: F.substring(F.lit(BASES), c.cast("int"), F.lit(1))
    alt = F.concat(base((F.col("i") + 1) % 4 + 1), F.when(F.col("i") % 11 == 0, "T").otherwise(""))
    value = F.concat_ws("\t", "chrom", (F.col("i") * 10 + 5).cast("string"), F.lit("."), base(F.col("i") % 4 + 1), alt, F.lit("50"), F.lit("PASS"), F.concat(F.lit("DP="), F.col("i").cast("string")), F.lit("UG:GT:GQ"), F.concat(F.lit("7:0/1:"), (F.col("i") % 60).cast("string")))
    head = spark.createDataFrame([(-1, "", k, v) for k, v in enumerate(HEADER)], "at long, chrom string, i long, value string")
    return _written(spark, head.union(rows.select(((F.col("i") * 7919) % 10007).alias("at"), "chrom", "i", value)), "at", "chrom", "i")


_VCF = f"""WITH {derived.MATRIX_SQL},
v AS (SELECT DISTINCT chrom, snp_idx AS i FROM m),
o AS (SELECT *, row_number() OVER (ORDER BY (i * 7919) % 10007, chrom, i) AS ln FROM v),
k AS (SELECT * FROM o WHERE i % 11 <> 0),
f AS (SELECT chrom, row_number() OVER (ORDER BY min(ln)) - 1 AS chrom_ord FROM k GROUP BY chrom),
t AS (SELECT chrom, chrom_ord, row_number() OVER (PARTITION BY chrom ORDER BY i) - 1 AS snp_idx, i * 10 + 5 AS pos,
  substr('{BASES}', (i % 4 + 1)::INTEGER, 1) AS ref, substr('{BASES}', ((i + 1) % 4 + 1)::INTEGER, 1) AS alt, i FROM k JOIN f USING (chrom))"""
_VCF_PHASED = _VCF + """,
p AS (SELECT t.*, CASE WHEN t.snp_idx % 5 <> 2 THEN t.snp_idx % 3 % 2 END AS gt, h.pos AS ps
  FROM t JOIN t h ON h.chrom = t.chrom AND h.snp_idx = t.snp_idx - t.snp_idx % 50)"""


def vcf_scan(spark, sf_dir):
    return vcf.variants(spark, _vcf(spark, sf_dir)).select("chrom", "chrom_ord", "snp_idx", "pos", "ref", "alt", F.size("fields").alias("n_fields"))


def vcf_chrom_filter(spark, sf_dir):
    return vcf.variants(spark, _vcf(spark, sf_dir), "c1").select("chrom", "chrom_ord", "snp_idx", "pos", "ref", "alt")


#: A header with a line for each customer between its other lines, and lines of variants behind it.
_CONTIG = "concat('<ID=k', c_custkey, ',note=', c_name, '=', c_nationkey, '>')"


def _headed(spark: SparkSession, sf_dir: str) -> str:
    fixed = spark.createDataFrame([(0, 0, HEADER[0]), (0, 1, HEADER[1]), (2, 0, HEADER[-1])], "at int, k long, value string")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    contigs = customers.selectExpr("1 AS at", "cast(c_custkey AS bigint) AS k", f"concat('##contig=', {_CONTIG}) AS value")
    variants = customers.selectExpr("3 AS at", "cast(c_custkey AS bigint) AS k", "concat_ws('\t', concat('k', c_custkey), '5', '.', 'A', 'C', '#', '.', '.', 'GT', '0/1') AS value")
    return _written(spark, fixed.union(contigs).union(variants), "at", "k")


def _headed_sql(more: tuple[str, ...] = ()) -> str:
    """(line_no, key, value, raw), with lines before the last."""
    line = lambda n, raw: f"SELECT {n} AS line_no, " + (f"{_literal(raw[2:].split('=', 1)[0])} AS key, {_literal(raw[2:].split('=', 1)[1])} AS value" if raw.startswith("##") else "NULL, NULL") + f", {_literal(raw)} AS raw"
    parts = [line(0, HEADER[0]), line(1, HEADER[1]), f"SELECT 1 + row_number() OVER (ORDER BY c_custkey), 'contig', {_CONTIG}, '##contig=' || {_CONTIG} FROM customer"]
    parts += [line(f"{k} + (SELECT count(*) FROM customer)", raw) for k, raw in enumerate((*more, HEADER[-1]), 2)]
    return " UNION ALL ".join(parts)


def vcf_header_parse(spark, sf_dir):
    return vcf.header(spark, _headed(spark, sf_dir))


def vcf_header_annotate(spark, sf_dir):
    return vcf.annotate_header(vcf.header(spark, _headed(spark, sf_dir))).select("line_no", "raw")


def _phased(spark: SparkSession, sf_dir: str) -> str:
    path, out = _vcf(spark, sf_dir), new_path(spark)
    table = vcf.variants(spark, path)
    i = F.col("snp_idx")
    vcf.write_phased(table, table.filter(i % 5 != 2).select("chrom", "snp_idx", (i - i % 50).alias("ps_idx"), (i % 3 % 2).cast("int").alias("phase")), vcf.header(spark, path), out)
    return out


def vcf_write_phased(spark, sf_dir):
    return numbered(lines(spark, _phased(spark, sf_dir)), "line_no").select("line_no", "value")


def phased_vcf_scan(spark, sf_dir):
    return vcf.phased_variants(spark, _phased(spark, sf_dir))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\t", "' || chr(9) || '") + "'"


_PS = vcf.FORMATS["PS"]
_ANNOTATED = [*HEADER[:-1], _PS, HEADER[-1]]

# A reference: three contigs of letters from digests of the nations' names, in lines of 60.

_DNA = "translate(md5(n_name || c), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_FASTA = f"""WITH s AS (SELECT c, string_agg({_DNA}, '' ORDER BY n_nationkey) AS seq FROM nation, (VALUES ('c0'), ('c1'), ('c2')) x(c) GROUP BY c)"""


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", F.explode(F.array(*[F.lit(f"c{k}") for k in range(3)])).alias("c"))
    dna = F.translate(F.md5(F.concat("n_name", "c").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    return names.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", dna.alias("x")))), lambda p: p["x"]), "").alias("seq"))


def _fasta(spark: SparkSession, sf_dir: str) -> str:
    rows = _sequences(spark, sf_dir)
    parts = rows.select("c", "seq", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / 60))).alias("k"))
    text = parts.select("c", "k", F.substring("seq", (F.col("k") * 60 + 1).cast("int"), F.lit(60)).alias("value"))
    return _written(spark, text.union(rows.select("c", F.lit(-1).cast("long"), F.concat(F.lit(">"), "c", F.lit(" a note")))), "c", "k")


def fasta_contig(spark, sf_dir):
    return fasta.contigs(spark, _fasta(spark, sf_dir))


def fasta_chunks(spark, sf_dir):
    return fasta.chunks(spark, _fasta(spark, sf_dir), 100, 10)


def window31_extract(spark, sf_dir):
    places = spark.range(1, 801).select(F.explode(F.array(*[F.lit(f"c{k}") for k in range(3)])).alias("chrom"), F.col("id").alias("snp_idx"), F.col("id").cast("int").alias("pos"), F.lit("A").alias("alt"))
    return calls.windows(places, fasta.chunks(spark, _fasta(spark, sf_dir)))


def _fai(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(key.alias("k"), F.concat_ws("\t", F.concat(F.lit("k"), key.cast("string")), (key * 1000 + 7).cast("string"), (key * 100000000000 + 3).cast("string"), F.lit("60"), F.lit("61")).alias("value"))
    return fasta.index(spark, _written(spark, rows, "k"))


def fai_scan(spark, sf_dir):
    return _fai(spark, sf_dir)


def fai_lookup(spark, sf_dir):
    chroms = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.lit("k"), F.col("c_nationkey").cast("string")).alias("chrom"))
    return fasta.lookup(chroms, _fai(spark, sf_dir)).select("c_custkey", "chrom", "length", "offset")


#: Letters of qualities, marks of records among them.
_QUALITIES = "@>+IF5#!=?ABCDEG"


def _fastq(letters: str, digest: str) -> str:
    return f"translate(md5({digest}), '0123456789abcdef', '{letters}')"


def _orders(letters: str, text: str, cast: str) -> list[str]:
    return [_fastq(letters, f"{cast.format('o_orderkey')} || '{text}{k}'") for k in range(2)]


def fastx_scan(spark, sf_dir):
    """A record for each order, its bases and its qualities on two lines each."""
    cast = "cast({} AS string)"
    bases, quals = _orders(BASES * 4, "b", cast), _orders(_QUALITIES, "q", cast)
    value = F.expr("concat('@o', o_orderkey, ' of ', o_custkey, '\n', {}, '\n', {}, '\n+\n', {}, '\n', {})".format(*bases, *quals))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", value.alias("value"))
    return fasta.records(spark, _written(spark, rows, "o_orderkey"))


_FASTX = "SELECT 'o' || o_orderkey AS name, 'of ' || o_custkey AS comment, {} || {} AS seq, {} || {} AS qual, 64 AS len FROM orders".format(*_orders(BASES * 4, "b", "{}::VARCHAR"), *_orders(_QUALITIES, "q", "{}::VARCHAR"))


# Reads: alleles as text, and alignments as SAM.


def allele_scan(spark, sf_dir):
    own = derived.alleles(spark, sf_dir).filter("chrom = 'c0'")
    call = F.array_sort(F.collect_list(F.struct("snp_idx", F.concat_ws(" ", (F.col("snp_idx") * 10 + 4).cast("string"), F.col("allele").cast("string")).alias("x"))))
    rows = own.groupBy("rid").agg(call.alias("x")).select("rid", F.concat_ws(" ", F.concat(F.lit("r"), F.col("rid").cast("string")), F.size("x").cast("string"), F.array_join(F.transform("x", lambda c: c["x"]), " ")).alias("value"))
    count = spark.createDataFrame([(-1, "many")], "rid long, value string")
    variants = own.select("chrom", F.col("snp_idx"), (F.col("snp_idx") * 10 + 5).cast("int").alias("pos")).distinct()
    return cut.matrix_view(alleles.allele_text(spark, _written(spark, count.union(rows), "rid"), variants, "c0")).select("chrom", "first", "calls")


_READ = "l_orderkey || '.' || l_linenumber"
_OPERATIONS = "5 + l_linenumber AS s, 20 + l_suppkey % 7 AS m, 1 + l_linenumber % 3 AS i, l_suppkey % 5 + 1 AS d"


def _alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(f"{_READ} AS name", "cast(l_linenumber % 2 * 16 AS string) AS flag", "concat('c', l_orderkey % 3) AS chrom", "cast(l_partkey + 1 AS string) AS pos", "cast(cast(l_quantity AS int) AS string) AS mapq", *_OPERATIONS.split(", "))
    cigar = F.expr("concat(s, 'S', m, 'M', i, 'I10M', d, 'D8M')")
    value = F.concat_ws("\t", "name", "flag", "chrom", "pos", "mapq", cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.expr("repeat('A', cast(s + m + i + 18 AS int))"), F.lit("*"))
    head = spark.createDataFrame([("", "@HD\tVN:1.6")], "name string, value string")
    return alignments.sam(spark, _written(spark, head.union(rows.select("name", value)), "name"))


_READ_BASES = " || ".join(f"translate(md5({_READ} || '{k}'), '0123456789abcdef', '{BASES * 4}')" for k in range(2))


def bam_scan(spark, sf_dir):
    """Alignments of every line of an order, written as BAM and read back without an index."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(f"{_READ} AS qname", "cast(l_linenumber % 2 * 16 AS int) AS flag", "concat('c', l_orderkey % 3) AS chrom", "cast(l_quantity AS int) AS mapq", "cast(l_partkey AS bigint) AS pos0", f"{_READ_BASES} AS bases", *_OPERATIONS.split(", "))
    operation = lambda op, n: F.struct(F.lit(op).alias("op"), n.cast("int").alias("len"))
    cigar = F.array(*[operation(op, F.col(n) if n in "smid" else F.lit(int(n))) for op, n in (("S", "s"), ("M", "m"), ("I", "i"), ("M", "10"), ("D", "d"), ("M", "8"))])
    own = rows.select("qname", "flag", "chrom", "mapq", "pos0", cigar.alias("cigar"), F.expr("substring(bases, 1, cast(s + m + i + 18 AS int))").alias("seq"))
    path = new_path(spark)
    alignments.write_bam(own, [(f"c{k}", 1 << 30) for k in range(3)], path)
    text = F.array_join(F.transform("cigar", lambda c: F.concat(c["len"].cast("string"), c["op"])), "")
    return alignments.bam(spark, path).select("qname", "flag", "chrom", "mapq", "pos0", text.alias("cigar"), "seq")


_BAM = f"""WITH o AS (SELECT *, {_READ} AS qname, {_READ_BASES} AS bases, {_OPERATIONS} FROM lineitem)
SELECT qname, (l_linenumber % 2 * 16)::INTEGER AS flag, 'c' || l_orderkey % 3 AS chrom, l_quantity::INTEGER AS mapq, l_partkey::BIGINT AS pos0,
  s || 'S' || m || 'M' || i || 'I10M' || d || 'D8M' AS cigar, substr(bases, 1, s + m + i + 18) AS seq FROM o"""


def sam_scan(spark, sf_dir):
    return _alignments(spark, sf_dir).select("qname", "chrom", "flag", "mapq", "pos0", F.size("cigar").alias("n_ops"), F.length("seq").alias("n_bases"))


def sam_spans(spark, sf_dir):
    """cigar_spans and cigar_query_pos of every alignment, 33 bases behind its start."""
    spans = cigar_spans(F.col("cigar"))
    return _alignments(spark, sf_dir).select("qname", spans["read_len"].cast("long").alias("read_len"), spans["ref_len"].cast("long").alias("ref_len"), query_pos(F.col("cigar"), F.col("pos0") + 1, F.col("pos0") + 34).alias("que_pos"))


def graph_sink(spark, sf_dir):
    from strandloom.operators.reads import informative_reads

    path = new_path(spark)
    alleles.graph_sink(alleles.graph_rows(informative_reads(derived.alleles(spark, sf_dir)), 2), path)
    return spark.read.option("header", True).option("sep", "\t").schema("chrom string, s long, node_u string, node_v string, cnt_u long, cnt_v long, weight long").csv(path)


# Functions over the tables.


def string_functions(spark, sf_dir):
    """join_str, base_code and roundup_pow2."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    joined = join_str(F.array(*[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]), ":")
    code = base_code(F.md5(F.col("l_orderkey").cast("string").cast("binary")))
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), joined.alias("joined"), code.alias("code"), roundup_pow2(F.col("l_partkey")).alias("pow2"))


def edit_distance_table(spark, sf_dir):
    """edit_distance_dp of two digests of every order."""
    dna = lambda c: F.translate(F.md5(c.cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), dna(F.col("o_orderkey")).alias("q"), dna(F.col("o_custkey")).alias("r"))
    return rows.select("id", edit_distance_dp("q", "r").alias("distance"))


def registered(graph_sql: str, reads_sql: str) -> dict[str, tuple]:
    """{name: (query, SQL)}. graph_sql and reads_sql: the tables of the trimmed graph of words of two, and of the reads."""
    annotated = ", ".join(f"({k}, {_literal(h)})" for k, h in enumerate(_ANNOTATED))
    bits = lambda c: f"({c} // 2)::VARCHAR || ({c} % 2)::VARCHAR"
    dna = lambda c: f"translate(md5({c}::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT')"
    window = "substr(seq, greatest(pos - 16, 0) + 1, least(pos + 15, 800) - greatest(pos - 16, 0))"
    place = "pos - greatest(pos - 16, 0)"
    made = {
        "vcf_scan": (vcf_scan, _VCF + " SELECT chrom, chrom_ord, snp_idx, pos, ref, alt, 10 AS n_fields FROM t"),
        "vcf_chrom_filter": (vcf_chrom_filter, _VCF + " SELECT chrom, 0 AS chrom_ord, snp_idx, pos, ref, alt FROM t WHERE chrom = 'c1'"),
        "vcf_header_parse": (vcf_header_parse, _headed_sql()),
        "vcf_header_annotate": (vcf_header_annotate, f"SELECT line_no, raw FROM ({_headed_sql((_PS,))})"),
        "vcf_write_phased": (vcf_write_phased, _VCF_PHASED + f""" SELECT * FROM (VALUES {annotated}) h(line_no, value) UNION ALL
SELECT {len(_ANNOTATED) - 1} + row_number() OVER (ORDER BY chrom_ord, snp_idx), concat_ws(chr(9), chrom, pos, '.', ref, alt, '50', 'PASS', 'DP=' || i, 'GT:GQ:PS:UG',
  concat_ws(':', CASE gt WHEN 0 THEN '0|1' WHEN 1 THEN '1|0' ELSE '0/1' END, i % 60, CASE WHEN gt IS NULL THEN '.' ELSE ps::VARCHAR END, '7')) FROM p"""),
        "phased_vcf_scan": (phased_vcf_scan, _VCF_PHASED + " SELECT chrom, pos, ps, gt FROM p WHERE gt IS NOT NULL"),
        "fasta_contig": (fasta_contig, _FASTA + " SELECT c AS name, length(seq) AS length, seq FROM s"),
        "fasta_chunks": (fasta_chunks, _FASTA + """ SELECT c AS chrom, k AS chunk, greatest(k * 100 - 10, 0) AS begin, length(seq) AS length,
  substr(seq, greatest(k * 100 - 10, 0) + 1, (k + 1) * 100 + 10 - greatest(k * 100 - 10, 0)) AS seq FROM s, (SELECT unnest(range(8)) AS k)"""),
        "window31_extract": (window31_extract, _FASTA + f""", w AS (SELECT c AS chrom, seq, unnest(range(1, 801)) AS pos FROM s)
SELECT chrom, pos AS snp_idx, pos, {window} AS ref_window, substr({window}, 1, {place} - 1) || 'A' || substr({window}, {place} + 1) AS alt_window FROM w"""),
        "fai_scan": (fai_scan, "SELECT 'k' || n_nationkey AS name, n_nationkey * 1000 + 7 AS length, n_nationkey::BIGINT * 100000000000 + 3 AS \"offset\", 60 AS line_bases, 61 AS line_width FROM nation"),
        "fai_lookup": (fai_lookup, "SELECT c_custkey, 'k' || c_nationkey AS chrom, n_nationkey * 1000 + 7 AS length, n_nationkey::BIGINT * 100000000000 + 3 AS \"offset\" FROM customer JOIN nation ON n_nationkey = c_nationkey"),
        "fastx_scan": (fastx_scan, _FASTX),
        "bam_scan": (bam_scan, _BAM),
        "allele_scan": (allele_scan, reads_sql + " SELECT chrom, min(snp_idx) AS first, string_agg(CASE WHEN allele < 0 THEN '-' ELSE allele::VARCHAR END, '' ORDER BY snp_idx) AS calls FROM a WHERE chrom = 'c0' GROUP BY chrom, rid"),
        "sam_scan": (sam_scan, f"SELECT {_READ} AS qname, 'c' || l_orderkey % 3 AS chrom, l_linenumber % 2 * 16 AS flag, l_quantity::INTEGER AS mapq, l_partkey AS pos0, 6 AS n_ops, 5 + l_linenumber + 20 + l_suppkey % 7 + 1 + l_linenumber % 3 + 18 AS n_bases FROM lineitem"),
        "sam_spans": (sam_spans, f"""WITH o AS (SELECT {_READ} AS qname, {_OPERATIONS} FROM lineitem)
SELECT qname, s + m + i + 18 AS read_len, m + 18 + d AS ref_len,
  CASE WHEN 33 < m + 10 THEN s + i + 33 WHEN 33 < m + 10 + d THEN s + m + i + 9 ELSE s + m + i + 10 + 33 - m - 10 - d END AS que_pos FROM o"""),
        "graph_sink": (graph_sink, graph_sql + f""" SELECT l.chrom, l.s, {bits("(l.e // 2)")} AS node_u, {bits("(l.e % 4)")} AS node_v, u.cnt AS cnt_u, v.cnt AS cnt_v, l.weight
FROM live l JOIN node u ON u.chrom = l.chrom AND u.s = l.s AND u.w = l.e // 2 JOIN node v ON v.chrom = l.chrom AND v.s = l.s + 1 AND v.w = l.e % 4"""),
        "string_functions": (string_functions, "SELECT l_orderkey AS id, l_linenumber AS line, concat_ws(':', l_orderkey, l_linenumber, l_partkey) AS joined, regexp_replace(upper(md5(l_orderkey::VARCHAR)), '[^ACGT]', 'N', 'g') AS code, CASE WHEN l_partkey <= 1 THEN 1 ELSE 1::BIGINT << length(bin(l_partkey - 1)) END AS pow2 FROM lineitem"),
        "edit_distance_table": (edit_distance_table, f"SELECT o_orderkey AS id, levenshtein({dna('o_orderkey')}, {dna('o_custkey')}) AS distance FROM orders"),
    }
    narrow = {
        "vcf_header_parse": ("line_no",), "vcf_header_annotate": ("line_no",), "vcf_scan": ("chrom_ord", "pos", "n_fields"), "vcf_chrom_filter": ("chrom_ord", "pos"), "phased_vcf_scan": ("pos", "ps", "gt"), "fasta_contig": ("length",),
        "fasta_chunks": ("chunk", "begin", "length"), "window31_extract": ("pos",), "fastx_scan": ("len",), "sam_scan": ("flag", "n_bases"),
    }
    for name, columns in narrow.items():
        run, sql = made[name]
        made[name] = run, f"SELECT * REPLACE ({', '.join(f'{c}::INTEGER AS {c}' for c in columns)}) FROM ({sql})"
    return made
