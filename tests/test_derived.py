from strandloom.operators import reads
from strandloom.plans import derived

SF = "/root/testdata/sf0.001"


def test_tasks_over_calls_grow_with_the_calls(spark, monkeypatch):
    """Reads are worked on where their orders were dealt to, in so many tasks that each has CALLS calls or so."""
    whole = sorted(map(tuple, reads.informative_reads(derived.alleles(spark, SF)).collect()))
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(derived, "CALLS", lines // 23)
    own = reads.informative_reads(derived.alleles(spark, SF))
    assert own.rdd.getNumPartitions() >= 23
    assert sorted(map(tuple, own.collect())) == whole
