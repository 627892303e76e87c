"""Reads simulated from the phases of a VCF, as SAM text and as a BAM file."""

import gzip
import random
import struct
import zlib

REF, ALT = "ACGT", {"A": "C", "C": "G", "G": "T", "T": "A"}


def genome(length=20000, every=150, seed=1):
    """A contig, its variants (pos, ref, alt) and their phases."""
    rng = random.Random(seed)
    seq = "".join(rng.choice(REF) for _ in range(length))
    places = [p for p in range(200, length - 200, every)]
    variants = [(p, seq[p - 1], ALT[seq[p - 1]]) for p in places]
    return seq, variants, [rng.randint(0, 1) for _ in variants]


def reads(seq, variants, phases, n=300, size=1500, errors=0.01, seed=2):
    """(name, pos0, cigar, bases) with substitutions, an insertion and a deletion each."""
    rng = random.Random(seed)
    haplotypes = []
    for h in (0, 1):
        own = list(seq)
        for (pos, _, alt), phase in zip(variants, phases):
            if phase ^ h:
                own[pos - 1] = alt
        haplotypes.append(own)
    for k in range(n):
        start = rng.randrange(0, len(seq) - size)
        own = haplotypes[rng.randint(0, 1)][start : start + size]
        own = [rng.choice(REF) if rng.random() < errors else b for b in own]
        a, d = size // 3, 2 * size // 3
        bases = "".join(own[:a]) + "GG" + "".join(own[a:d]) + "".join(own[d + 3 :])
        yield f"r{k}", start, [("M", a), ("I", 2), ("M", d - a), ("D", 3), ("M", size - d - 3)], bases


def vcf_lines(variants, chrom="1"):
    yield "##fileformat=VCFv4.2"
    yield f"##contig=<ID={chrom}>"
    yield "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"
    for pos, ref, alt in variants:
        yield f"{chrom}\t{pos}\t.\t{ref}\t{alt}\t50\tPASS\tDP=9\tGQ:GT\t30:0/1"


def sam_lines(found, chrom="1"):
    yield "@HD\tVN:1.6"
    for name, pos0, cigar, bases in found:
        yield f"{name}\t0\t{chrom}\t{pos0 + 1}\t60\t{''.join(f'{n}{op}' for op, n in cigar)}\t*\t0\t0\t{bases}\t*"


def bam_records(contigs, found):
    """The header and every record as bytes. found: (contig number, name, pos0, cigar, bases)."""
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(contigs))
    for name, length in contigs:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    yield head
    for number, name, pos0, cigar, bases in found:
        codes = ["=ACMGRSVTWYHKDBN".index(b) for b in bases] + [0] * (len(bases) % 2)
        body = struct.pack("<iiBBHHHiiii", number, pos0, len(name) + 1, 60, 0, len(cigar), 0, len(bases), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=XB".index(op)) for op, n in cigar)
        body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + b"\xff" * len(bases)
        yield struct.pack("<i", len(body)) + body


def write_bam(path, contigs, found):
    """In the order of `found`, in several gzip members."""
    with open(path, "wb") as f:
        for m in bam_records(contigs, found):
            f.write(gzip.compress(m))


def write_indexed_bam(path, contigs, found, size=700, kind="bai"):
    """In blocks of `size` bytes that say their size, records running over their ends, with an index of windows, of runs ("csi") or none. found is sorted."""
    parts = list(bam_records(contigs, found))
    data, starts = b"".join(parts), []
    for p in parts:
        starts.append((starts[-1][1] if starts else 0, (starts[-1][1] if starts else 0) + len(p)))
    places, out = [], b""
    for k in range(0, len(data), size):
        places.append(len(out))
        body = zlib.compressobj(6, zlib.DEFLATED, -15)
        own = data[k : k + size]
        packed = body.compress(own) + body.flush()
        out += struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(own), len(own))
    with open(path, "wb") as f:
        f.write(out)
    at = [places[a // size] << 16 | a % size for a, _ in starts[1:]]
    if kind == "csi":
        index = b"CSI\1" + struct.pack("<iii", 14, 5, 0) + struct.pack("<i", len(contigs))
        for number in range(len(contigs)):
            own = [o for r, o in zip(found, at) if r[0] == number]
            index += struct.pack("<i", len(own[::40]) + bool(own))
            for k, o in enumerate(own[::40]):
                index += struct.pack("<IQiQQ", 4681 + k, o, 1, o, o + 1)
            if own:
                index += struct.pack("<IQiQQ", 37450, 0, 1, 3, 4)
        with gzip.open(path + ".csi", "wb") as f:
            f.write(index)
    if kind != "bai":
        return
    index = b"BAI\1" + struct.pack("<i", len(contigs))
    for number in range(len(contigs)):
        own = [(r[2], o) for r, o in zip(found, at) if r[0] == number]
        windows = {}
        for pos, o in own:
            windows.setdefault(pos >> 14, o)
        index += struct.pack("<i", bool(own))
        if own:
            index += struct.pack("<IiQQ", 0, 1, own[0][1], own[-1][1])
        line = [windows.get(w, 0) for w in range(max(windows, default=-1) + 1)]
        index += struct.pack(f"<i{len(line)}Q", len(line), *line)
    with open(path + ".bai", "wb") as f:
        f.write(index)
