"""Queries that write a given table in a format and read it back, against their SQL."""

import duckdb
import pytest

from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = ["s_matrix", "s_json", "s_ontology", "s_annotations", "s_links", "s_molecules", "s_masses", "s_cross_reference", "s_associations", "k_report", "k_clusters"]


@pytest.mark.parametrize("name", NAMES)
def test_what_was_written_is_read(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "part", "supplier"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    res = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(df.columns)
    blank = lambda row: tuple((v is None, v) if v is not None else (True, "") for v in row)
    want = sorted(blank(r[names.index(c)] for c in df.columns) for r in res.fetchall())
    got = sorted(blank(r) for r in df.collect())
    assert got == want and want
