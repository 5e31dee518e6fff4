"""The first point of each voxel against its SQL: rows without id, coordinates that are no place, ids that repeat."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SCHEMA = "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_extendedprice double, l_partkey long, l_suppkey long"


def both(spark, path, rows, sql=None):
    """Rows of the query and of its SQL, nulls and NaN as text."""
    spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet/*.parquet'")
    got = entry.queries()["r5_voxel_first"](spark, str(path)).collect()
    return sorted(str(tuple(r)) for r in got), sorted(str(r) for r in con.execute(sql or entry.oracle_sql()["r5_voxel_first"]).fetchall())


def test_rows_without_id_come_last(spark, tmp_path):
    got, want = both(spark, tmp_path, [(None, 1, 1.0, 0.0, 10.0), (7, 2, 2.0, 0.0, 20.0), (9, None, 2.0, 0.0, 20.0), (None, 3, 11.0, 0.0, 10.0)])
    assert got == want and len(got) == 2 and "(58, 2.0, 0.0, 0.02)" in got


@pytest.mark.parametrize("odd", (math.nan, math.inf, -math.inf, 1e300, -1e300, None))
def test_odd_coordinates_are_voxels_of_their_own(spark, tmp_path, odd):
    places = (odd, 1.0, -1.0, 4e19, 8e19, -4e19, -8e19)
    got, want = both(spark, tmp_path, [(n, 1, x, 0.0, 10.0) for n, x in enumerate(places)] + [(n + 10, 2, 1.0, 0.0, x) for n, x in enumerate(places)])
    assert got == want and len(got) == 13


def test_rows_of_one_id_give_the_least(spark, tmp_path):
    """The SQL leaves the choice open and takes either row; the query takes the same one from any partitioning."""
    rows = [(183, 5, 23.0, 0.01, 99382.49), (183, 5, 20.0, 0.01, 96780.04), (184, 5, 21.0, 0.01, 97000.0)]
    ordered = entry.oracle_sql()["r5_voxel_first"].replace("ORDER BY id", "ORDER BY id, x, y, z")
    for n, order in enumerate((rows, rows[::-1])):
        got, want = both(spark, tmp_path / str(n), order, ordered)
        assert got == want == ["(1469, 20.0, 5.0, 96.78004)"]
