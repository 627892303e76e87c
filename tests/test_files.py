import contextlib
import gzip
import random

import pyarrow as pa
import pytest
import simulate
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandloom import __main__ as cli
from strandloom.operators import calls
from strandloom.sources import alignments, alleles, fasta, pieces, vcf


def put(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    seq, variants, phases = simulate.genome()
    found = list(simulate.reads(seq, variants, phases))
    wrapped = [seq[k : k + 60] for k in range(0, len(seq), 60)]
    out = {
        "ref": put(top / "ref.fa", [">1 first", *wrapped, ">2", "ACGTN", "acg"]),
        "vcf": put(top / "in.vcf", simulate.vcf_lines(variants)),
        "sam": put(top / "reads.sam", simulate.sam_lines(found)),
        "bam": str(top / "reads.bam"),
        "seq": seq, "variants": variants, "phases": phases, "found": found, "top": top,
    }
    simulate.write_bam(out["bam"], [("1", len(seq)), ("2", 8)], [(0, *r) for r in found] + [(1, "x", 2, [("M", 3)], "GTN")])
    return out


def test_contigs_and_chunks(spark, files):
    got = {r.name: r.seq for r in fasta.contigs(spark, files["ref"]).collect()}
    assert got == {"1": files["seq"], "2": "ACGTNacg"}
    put(files["top"] / "x.fai", ["1\t49900\t3\t50\t51", ""])
    assert fasta.index(spark, str(files["top"] / "x.fai")).first().line_width == 51
    assert fasta.chunks(spark, files["ref"]).filter("chrom = '2'").first().seq == "ACGTNacg"


def test_chunks_of_many_lines(spark, files):
    """Lines of odd lengths, contigs that end within a chunk, one without bases; read whole and in many blocks."""
    rng = random.Random(3)
    whole = {f"k{k}": "".join(rng.choice("ACGTN") for _ in range(n)) for k, n in enumerate((1, 997, 64, 0, 2500, 130))}
    rows = []
    for name, seq in whole.items():
        rows.append(f">{name} note")
        while seq:
            n = rng.randint(1, 90)
            rows.append(seq[:n] + rng.choice(["", " "]))
            seq = seq[n:]
        rows += [""] * rng.randint(0, 1)
    path = put(files["top"] / "many.fa", rows)
    for block in ("128m", "300"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if block == "300" else "4m")
        try:
            got = {(r.chrom, r.chunk): (r.begin, r.length, r.seq) for r in fasta.chunks(spark, path, 64, 16).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        want = {}
        for name, seq in whole.items():
            for c in range(-(-len(seq) // 64)):
                begin = max(64 * c - 16, 0)
                want[name, c] = (begin, len(seq), seq[begin : 64 * (c + 1) + 16])
        assert got == want


def test_contigs_that_are_missing(spark, files):
    table = vcf.variants(spark, put(files["top"] / "other.vcf", [*simulate.vcf_lines(files["variants"][:3], "1"), *[r.replace("1\t", "7\t", 1) for r in list(simulate.vcf_lines(files["variants"][:3], "1"))[3:]]]))
    with pytest.raises(Exception, match="no reference at 7:"):
        calls.windows(table, fasta.chunks(spark, files["ref"])).collect()
    index = spark.createDataFrame([("1", 20000), ("7", 0)], "name string, length int")
    assert fasta.lookup(table.filter("chrom = '1'").select("chrom").distinct(), index).first().length == 20000
    with pytest.raises(Exception, match="no reference for 7"):
        fasta.lookup(table.select("chrom").distinct(), index).collect()


def test_records(spark, files):
    path = put(files["top"] / "a.fq", ["@r1 note", "ACG", "T", "+", "IIII", ">f2", "AC", "", "GT"])
    got = {r.name: (r.comment, r.seq, r.qual, r.len) for r in fasta.records(spark, path).collect()}
    assert got == {"r1": ("note", "ACGT", "IIII", 4), "f2": ("", "ACGT", None, 4)}
    with pytest.raises(ValueError, match="quality"):
        list(fasta.parse_records("@r\nACGT\n+\nII\n"))


def test_sam_and_bam_agree(spark, files):
    columns = ["chrom", "qname", "flag", "mapq", "pos0", "cigar", "seq"]
    one = {tuple(map(str, r)) for r in alignments.sam(spark, files["sam"]).select(*columns).collect()}
    two = {tuple(map(str, r)) for r in alignments.bam(spark, files["bam"]).filter("chrom = '1'").select(*columns).collect()}
    assert one == two and len(one) == len(files["found"])
    assert alignments.bam(spark, files["bam"]).filter("chrom = '2'").first().seq == "GTN"


def test_bam_in_pieces(spark, files):
    """An indexed file, a partition for each window that begins a block, gives what the same file in one gives."""
    rng = random.Random(5)
    found = sorted((rng.randint(0, 2) * 2 % 3, f"r{k}", rng.randrange(200_000), [("M", 9)], "".join(rng.choice("ACGTN") for _ in range(9))) for k in range(500))
    found = sorted(found, key=lambda r: (r[0], r[2]))
    contigs = [("a", 10**6), ("b", 10**6), ("c", 10**6)]
    plain, cut = str(files["top"] / "plain.bam"), str(files["top"] / "cut.bam")
    simulate.write_bam(plain, contigs, found)
    simulate.write_indexed_bam(cut, contigs, found)
    columns = ["chrom", "qname", "flag", "mapq", "pos0", "cigar", "seq"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    one, many = alignments.bam(spark, plain), alignments.bam(spark, cut, split=1000)
    assert rows(one) == rows(many) and one.count() == len(found)
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() > 5
    assert rows(one.filter("chrom = 'c'")) == rows(alignments.bam(spark, cut, "c", 1000)) == rows(alignments.bam(spark, plain, "c")) and many.filter("chrom = 'b'").count() == sum(r[0] == 1 for r in found)
    assert many.select("rid").distinct().count() == len(found) == one.select("rid").distinct().count()


@contextlib.contextmanager
def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def random_reads(n, seed, longest=9):
    """Sorted alignments; some much longer than a block or a split, whose qualities are all 255."""
    rng = random.Random(seed)
    sizes = [rng.randint(1, longest) for _ in range(n)]
    return sorted(((rng.randint(0, 2) * 2 % 3, f"r{k}", rng.randrange(200_000), [("M", m)], "".join(rng.choice("ACGTN") for _ in range(m))) for k, m in enumerate(sizes)), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("split, longest, size", [(1500, 9, 700), (700, 30, 200), (400, 4000, 333), (100_000, 4000, 60_000)])
def test_bam_by_splits(spark, files, split, longest, size):
    """Without an index, in splits that records, or the header, run over, a file gives what it gives in one."""
    found, contigs = random_reads(150, split, longest), [(c * 40, 10**6) for c in "abc"]
    cut, plain = str(files["top"] / f"splits{split}.bam"), str(files["top"] / f"one{split}.bam")
    simulate.write_indexed_bam(cut, contigs, found, size, kind=None)
    simulate.write_bam(plain, contigs, found)
    columns = ["chrom", "qname", "flag", "mapq", "pos0", "cigar", "seq"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    with small_splits(spark, split):
        many = alignments.bam(spark, cut)
        got = many.select("rid", *columns).collect()
        assert sorted(str(Row(**{c: r[c] for c in columns})) for r in got) == rows(alignments.bam(spark, plain)) and len(got) == len(found)
        assert len({r.rid for r in got}) == len(found) and {r.rid for r in got} == {r.rid for r in many.select("rid").collect()}
        assert rows(alignments.bam(spark, cut, "c" * 40)) == rows(many.filter(F.col("chrom") == "c" * 40))
        assert split == 100_000 or alignments.pieces.read(spark, cut, F.lit(""), F.lit(True)).rdd.getNumPartitions() > 4


def test_bam_with_csi_index(spark, files):
    found, contigs = random_reads(400, 8), [("a", 10**6), ("b", 10**6), ("c", 10**6)]
    one, two = str(files["top"] / "csi.bam"), str(files["top"] / "none.bam")
    simulate.write_indexed_bam(one, contigs, found, kind="csi")
    simulate.write_indexed_bam(two, contigs, found, kind=None)
    columns = ["chrom", "qname", "pos0", "cigar", "seq"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    got = alignments.bam(spark, one, split=1000)
    assert rows(got) == rows(alignments.bam(spark, two)) and got.rdd.getNumPartitions() > 5


def test_bam_that_is_cut_off(spark, files):
    """A file whose end is missing is an error, within a block and between blocks; so is one with a byte changed."""
    found, contigs = random_reads(200, 4, 400), [("a", 10**6), ("b", 10**6), ("c", 10**6)]
    path = files["top"] / "end.bam"
    simulate.write_indexed_bam(str(path), contigs, found, 700, kind=None)
    data = path.read_bytes()
    block = data.index(alignments.BLOCK, len(data) // 2)
    changed = bytearray(data)
    changed[len(data) // 2] ^= 8
    for k, part in enumerate((data[: block - 30], data[:block], bytes(changed))):
        bad = files["top"] / f"end{k}.bam"
        bad.write_bytes(part)
        with small_splits(spark, 5000), pytest.raises(Exception, match="block|whole records|decompress"):
            alignments.bam(spark, str(bad)).count()


def test_written_bam_is_read_back(spark, files):
    columns = ["chrom", "qname", "flag", "mapq", "pos0", "cigar", "seq"]
    rows = alignments.sam(spark, files["sam"]).repartition(5)
    out = str(files["top"] / "written.bam")
    alignments.write_bam(rows, [("1", len(files["seq"]))], out)
    with small_splits(spark, 20_000):
        got = alignments.bam(spark, out)
        assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, rows.select(*columns).collect()))
    nothing = str(files["top"] / "nothing.bam")
    alignments.write_bam(rows.limit(0), [("1", 9)], nothing)
    assert alignments.bam(spark, nothing).count() == 0
    whole = b"".join(p.read_bytes() for p in sorted((files["top"] / "written.bam").glob("part-*")))
    joined = files["top"] / "joined.bam"
    joined.write_bytes(whole)
    assert gzip.decompress(whole)[:4] == b"BAM\1" and alignments.bam(spark, str(joined)).count() == len(files["found"])


def sequence_lines(rng, kind):
    """Records whose qualities begin with the marks of records, on one line or many; odd lines before the first."""
    rows, want = ["a line", ""], []
    for k in range(rng.randint(25, 40)):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 90)))
        mark = {"fastq": "@", "wrapped": "@", "fasta": ">", "both": rng.choice(">@")}[kind]
        qual = "".join(rng.choice("@>+IF5#") for _ in seq) if mark == "@" else None
        width = len(seq) if kind == "fastq" else rng.randint(7, 30)
        rows += [f"{mark}s{k} of {kind}", *[seq[a : a + width] for a in range(0, len(seq), width)]]
        if qual:
            rows += ["+", *[qual[a : a + width] for a in range(0, len(seq), width)]]
        elif rng.random() < 0.2:
            rows.append("")
        want.append((f"s{k}", f"of {kind}", seq, qual, len(seq)))
    return rows, want


@pytest.mark.parametrize("kind", ["fastq", "wrapped", "fasta", "both"])
def test_records_by_splits(spark, files, kind):
    """Files that are read in many splits give the records of the whole text."""
    rng = random.Random(kind)
    top = files["top"] / f"records_{kind}"
    top.mkdir()
    want = []
    for k in range(2):
        rows, own = sequence_lines(rng, kind)
        put(top / f"{k}.fq", rows)
        assert list(fasta.parse_records("\n".join(rows))) == [w[:4] for w in own]
        want += own
    for size in (150, 1000, 1 << 20):
        with small_splits(spark, size):
            got = fasta.records(spark, str(top))
            assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_lines_of_a_part_are_taken_together():
    """Not one by one; those of two parts stay apart, and no more than the format says are taken at once."""
    part = [{"stream": "s", "file": "f", "block": b} for b in (0, 0, 0, 9, 9)]
    kind = pa.struct([("stream", pa.string()), ("file", pa.string()), ("block", pa.int64())])
    batch = pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([True] * 3 + [False] * 2), pa.array([7] * 5), pa.array([b"a", b"b", b"c", b"d", b"e"])], names=["part", "first", "number", "value"])
    taken = []
    form = pieces.Format(lambda rows: taken.append(list(rows)) or b"".join(rows), lambda data: 0, lambda data, at, final, number: ([], at), lambda data, at: at, rows=2)
    left = [(key["block"], p.left()) for key, p, _, ended in pieces._walk(iter([batch]), form, False) if ended]
    assert taken == [[b"a", b"b"], [b"c"], [b"d", b"e"]]
    assert left == [(0, [(0, b"", 7), (1, b"abc", 7)]), (9, [(0, b"", 10), (1, b"de", 10)])]


def test_sequence_file_that_is_cut_off(spark, files):
    rows, _ = sequence_lines(random.Random(1), "fastq")
    path = put(files["top"] / "cut.fq", rows[:-1])
    with small_splits(spark, 500), pytest.raises(Exception, match="quality of 0"):
        fasta.records(spark, path).count()
    (files["top"] / "empty.fq").write_text("")
    assert fasta.records(spark, str(files["top"] / "empty.fq")).count() == 0


def naive_calls(files):
    """Query positions by walking each read base by base, and the nearer of the two windows."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    seq, out = files["seq"], {}
    for name, pos0, cigar, bases in files["found"][:40]:
        at, q, r = {}, 0, pos0 + 1
        for op, n in cigar:
            for _ in range(n):
                if op in "MD":
                    at[r] = q if op == "M" else q - 1
                    r += 1
                q += op in "MI"
        own = []
        for k, (pos, _, alt) in enumerate(files["variants"]):
            if pos in at:
                left, right = max(pos - 16, 0), min(pos + 15, len(seq))
                ref = seq[left:right]
                other = ref[: pos - 1 - left] + alt + ref[pos - left :]
                query = bases[max(at[pos] - 15, 0) : at[pos] + 16]
                a, b = distance(query, ref), distance(query, other)
                own.append((k, at[pos], 0 if a < b else 1 if a > b else -1))
        while own and own[0][2] < 0:
            own.pop(0)
        while own and own[-1][2] < 0:
            own.pop()
        if len(own) > 1:
            out[name] = own
    return out


def test_detected_alleles(spark, files):
    aligned = alignments.sam(spark, files["sam"])
    table = vcf.variants(spark, files["vcf"])
    found = calls.detect_alleles(aligned, table, fasta.chunks(spark, files["ref"]))
    names = {r.rid: r.qname for r in aligned.collect()}
    got = {}
    for r in found.orderBy("rid", "snp_idx").collect():
        got.setdefault(names[r.rid], []).append((r.snp_idx, r.que_pos, r.allele))
    want = naive_calls(files)
    assert want and all(got[name] == own for name, own in want.items())


@pytest.mark.parametrize("source", ["sam", "bam"])
def test_phasing_from_files(spark, files, source):
    out = str(files["top"] / f"phased_{source}")
    assert cli.main(["-v", files["vcf"], "-b", files[source], "-r", files["ref"], "-o", out, "-l", str(files["top"] / "graph"), "-c", "1"]) == 0
    head = vcf.header(spark, out)
    assert {r.raw for r in head.collect()} >= set(vcf.FORMATS.values()) and vcf.samples(head) == 1
    got = vcf.phased_variants(spark, out).orderBy("pos").collect()
    assert [r.pos for r in got] == [p for p, _, _ in files["variants"]]
    assert {r.ps for r in got} == {files["variants"][0][0]}
    turned = {r.gt ^ p for r, p in zip(got, files["phases"])}
    assert len(turned) == 1
    line = next(r.value for r in spark.read.text(out).collect() if not r.value.startswith("#"))
    assert line.split("\t")[8] == "GT:GQ:PS" and line.split("\t")[9].split(":")[1] == "30"
    edges = {}
    for step in ("1_init", "2_trim", "3_tip", "4_bubble"):
        graph = spark.read.option("sep", "\t").option("header", True).csv(str(files["top"] / "graph" / step))
        edges[step] = {(r.s, r.node_u, r.node_v) for r in graph.collect()}
        assert len(graph.first().node_u) == 2
    assert edges["1_init"] >= edges["2_trim"] >= edges["3_tip"] and edges["4_bubble"]


def test_allele_text(spark, files):
    table = vcf.variants(spark, files["vcf"])
    p = [v[0] - 1 for v in files["variants"]]
    path = put(files["top"] / "alleles.txt", ["2", f"a 3 {p[0]} 1 {p[1]} -1 {p[3]} 0", f"b 2 {p[0]} -1 {p[1]} 1"])
    got = [(r.snp_idx, r.allele) for r in alleles.allele_text(spark, path, table).orderBy("snp_idx").collect()]
    assert got == [(0, 1), (1, -1), (2, -1), (3, 0)]
    two = table.union(table.limit(1).selectExpr("'z' AS chrom", *table.columns[1:]))
    with pytest.raises(ValueError, match="several"):
        alleles.allele_text(spark, path, two)
    assert alleles.allele_text(spark, path, two, "1").count() == 4
    bad = put(files["top"] / "bad.txt", ["1", "a 2 5 1 6 1"])
    with pytest.raises(Exception, match="no variant at"):
        alleles.allele_text(spark, bad, table).count()


def test_lines_that_lack_fields(spark, files):
    head = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS"]
    rows = ["2\t5\t.\tA\tC\t.\t.\t.\tGT\t0/1", "2\t5\t.\tA\tG\t.\t.\t.\tUG:GT:PS\t1:0/1:7", "1\t9\t.\tAT\tC\t.\t.\t.\tGT\t0/1", "1\t3\t.\tA\tC\t.\t.\t."]
    table = vcf.variants(spark, put(files["top"] / "odd.vcf", head + rows))
    assert [(r.chrom, r.snp_idx, r.alt) for r in table.orderBy("chrom_ord", "snp_idx").collect()] == [("2", 0, "C"), ("2", 1, "G"), ("1", 0, "C")]
    phases = spark.createDataFrame([("2", 0, 0, 1), ("2", 1, 0, 0)], "chrom string, snp_idx long, ps_idx long, phase int")
    got = [r.value.split("\t")[8:] for r in vcf.phased_lines(table, phases).orderBy("chrom_ord", "snp_idx").collect()]
    assert got == [["GT:PS", "1|0:5"], ["GT:UG:PS", "0|1:1:5"], []]


def test_written_phases_are_read_back(spark, files):
    table = vcf.variants(spark, files["vcf"])
    phases = table.select("chrom", "snp_idx", (F.col("snp_idx") - F.col("snp_idx") % 10).alias("ps_idx"), (F.col("snp_idx") % 3 % 2).cast("int").alias("phase")).filter("snp_idx % 5 <> 2")
    out = str(files["top"] / "back")
    vcf.write_phased(table, phases, vcf.header(spark, files["vcf"]), out)
    place = [v[0] for v in files["variants"]]
    want = [(place[k], place[k - k % 10], k % 3 % 2) for k in range(len(place)) if k % 5 != 2]
    assert [(r.pos, r.ps, r.gt) for r in vcf.phased_variants(spark, out).orderBy("pos").collect()] == want
    assert vcf.variants(spark, out).count() == len(place)
