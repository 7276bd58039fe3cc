"""Queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from voidframe import queries

SF = "/root/testdata/sf0.001"
QUICK = ["p1_guess_element", "j16_element_parameters", "s6_atom_parameters", "p6_box_inference", "p9_cell_index", "j2_voxel_nearest", "g3_runs", "a12_density", "h1_octree", "s2_gro_round_trip"]


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, name):
    db = duckdb.connect()
    for t in ("customer", "part"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    flat = lambda d: sorted(map(tuple, d[cols].astype(str).values.tolist()))
    assert cols == sorted(want.columns) and flat(got) == flat(want)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
