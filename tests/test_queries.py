"""Every registered graph query against its SQL on the smallest tables."""

import glob
import os

import pytest

from causeway.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


#: Models, sequential methods and generated tables.
NO_SQL = {"rf_scores", "sgc_scores", "network_scores"}


def test_all_have_sql():
    assert set(QUERIES) == set(SQL) | NO_SQL


@pytest.mark.parametrize("name", ["rf_scores", "sgc_scores", "network_scores"])
def test_scores(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.count() == 1000 and out.where("score between 0 and 1").count() == 1000


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, duck, name):
    want = duck.sql(SQL[name])
    out = QUERIES[name](spark, SF)
    assert sorted(out.columns) == sorted(want.columns)
    shown = lambda rows: sorted(str([round(x, 5) + 0.0 if isinstance(x, float) else x for x in r]) for r in rows)
    assert shown(map(tuple, out.select(*want.columns).collect())) == shown(want.fetchall())
