"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from matrelate.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Queries on matrices with SQL; those of the text side have tests of their own.
NAMES = sorted(catalogue.ORACLES)
#: Rounds of Spark jobs: their solvers are compared with the local path in test_solvers.
LONG = {name for name in NAMES if name.endswith("_distributed")} - {"invert_distributed"}
TOLERANCE = {"gram_embeddings": 2e-4, "wom_gc": 2e-4, "wom_c": 2e-4, "estimate_gap": 2e-4, "power_bounds": 2e-2, "eigen_reconstruction": 2e-4, "purification_extrapolate": 2e-4}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in NAMES if n not in LONG])
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalogue.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [c for c in ("i", "j") if c in columns] or columns
    got, want = (x[columns].sort_values(order).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        if got[c].dtype == object or want[c].dtype == object or str(got[c].dtype) == "str":
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist()
        else:
            gap = (got[c].astype(float) - want[c].astype(float)).abs()
            assert (gap <= TOLERANCE.get(name, 2e-5) + 1e-9 * want[c].astype(float).abs()).all()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
