"""Every query against its SQL in an independent engine."""

import math
from pathlib import Path

import duckdb
import pytest

from streamloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: "null" if v is None else f"{v:.6f}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(clean(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    mine = plain([tuple(r) for r in got.collect()], got.columns)
    assert mine == plain(want.fetchall(), names)
    assert mine


def test_scalar_functions_of_far_days(spark, tmp_path):
    """Years of more than four digits, of less, and before year 0."""
    keys = [None, 0, 149_999, 2_932_896, 2_932_897, 9_000_000, 99_999_999, 2_147_483_646, -1, -719_162, -719_528, -719_529, -1_000_000, -8_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.QUERIES["scalar_functions"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = c.execute(catalog.ORACLE_SQL["scalar_functions"])
    names = [d[0] for d in want.description]
    mine = plain([tuple(r) for r in got.collect()], got.columns)
    assert len(mine) == len(keys) and mine == plain(want.fetchall(), names)
