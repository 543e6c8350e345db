"""The queries that take whole tables against their SQL."""

import duckdb
import pytest

from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = ["t_two_frames_sub", "t_concat_rows", "t_concat_cols", "e_background", "e_termlen"]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "part"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    res = con.execute(catalogue.ORACLES[name])
    at = [[c[0] for c in res.description].index(c) for c in df.columns]
    want = sorted(tuple(r[i] for i in at) for r in res.fetchall())
    assert sorted(map(tuple, df.collect())) == want and want


def test_every_term_counts_the_whole_bridge(spark):
    bridge = catalogue.a.bridge(spark, SF)
    sizes = {r.term: r["count"] for r in bridge.groupBy("term").count().collect()}
    got = catalogue.QUERIES["e_termlen"](spark, SF).groupBy("term").count().collect()
    assert {r.term: r["count"] for r in got} == {t: n for t, n in sizes.items() if n < 45}
