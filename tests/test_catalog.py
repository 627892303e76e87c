"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from strandloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for table in ("lineitem", "orders", "nation", "customer"):
        c.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    rel = con.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    order = lambda row: tuple((x is not None, x if x is not None else 0) for x in row)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=order)
    want = sorted((tuple(dict(zip(rel.columns, r))[c] for c in columns) for r in rel.fetchall()), key=order)
    assert got == want
    assert got or name.startswith("symmetry_check")


def test_queries_without_sql_have_rows(spark):
    """Those of K=3 differ from K=2 in a number only, and are held against the plain model elsewhere; they are left out for their time."""
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLES)):
        if not name.endswith("_k3"):
            assert catalog.QUERIES[name](spark, SF).count() > 0, name


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["chrom", "snp_idx", "ps_idx", "phase"] and df.count() > 0
