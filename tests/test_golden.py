"""A hundred known variants over 27 kb: from files to the phases that are known for them, one phase set."""

import random

import simulate
from test_files import put

from strandloom import __main__ as cli

#: Positions of the variants, and their phases (0 is 0|1).
POSITIONS = [
    12198, 12383, 19600, 20128, 20136, 20221, 20227, 20245, 20304, 20321, 20467, 20512, 20729, 20813, 20914, 20960, 21010, 21026, 21093, 21121,
    21335, 21352, 21411, 21420, 21503, 21515, 21796, 21841, 21991, 22018, 22113, 22158, 22195, 22249, 23811, 23881, 23975, 24099, 24114, 24132,
    24145, 24220, 24302, 24308, 24420, 24436, 25505, 25733, 25876, 25984, 26266, 26711, 26957, 27395, 27489, 27876, 27969, 28175, 28247, 28376,
    28563, 28663, 28835, 28959, 29397, 29571, 29696, 29725, 29790, 29894, 30028, 30037, 30104, 30376, 30489, 30636, 30672, 30728, 30860, 30923,
    31285, 31467, 32067, 32073, 32341, 32347, 32385, 32756, 34408, 34771, 35510, 36128, 36593, 36725, 36741, 36851, 36923, 37055, 38889, 39255,
]
PHASES = "0010100111111111111111111111111111101111111111111111111110111111101111110111111111110111000000000011"


def test_known_phases_from_files(spark, tmp_path):
    """Reads of 9 kb, longer than the widest gap between two variants, with errors; the genotypes that come out are those that went in."""
    rng = random.Random(12198)
    seq = "".join(rng.choice("ACGT") for _ in range(49_900))
    variants = [(p, seq[p - 1], simulate.ALT[seq[p - 1]]) for p in POSITIONS]
    found = sorted(simulate.reads(seq, variants, [int(c) for c in PHASES], n=260, size=9000, errors=0.01), key=lambda r: r[1])
    ref = put(tmp_path / "ref.fa", [">1", *[seq[k : k + 50] for k in range(0, len(seq), 50)]])
    vcf = put(tmp_path / "in.vcf", simulate.vcf_lines(variants))
    sam = put(tmp_path / "reads.sam", simulate.sam_lines(found))
    for k in (2, 3):
        out = tmp_path / f"out{k}"
        assert cli.main(["-v", vcf, "-b", sam, "-r", ref, "-o", str(out), "-k", str(k)]) == 0
        rows = [line.split("\t") for part in sorted(out.glob("part-*")) for line in part.read_text().splitlines() if not line.startswith("#")]
        keys = [dict(zip(r[8].split(":"), r[9].split(":"))) for r in rows]
        assert [int(r[1]) for r in rows] == POSITIONS
        assert {x["PS"] for x in keys} == {"12198"}
        called = "".join(str(int(x["GT"] == "1|0")) for x in keys)
        assert called in (PHASES, PHASES.translate(str.maketrans("01", "10"))) and set(x["GT"] for x in keys) == {"0|1", "1|0"}
        assert sorted((called.count("0"), called.count("1"))) == [20, 80]
