"""Every query that has SQL gives the same rows as its SQL on the smallest tables; every other one runs."""

import importlib

import pytest
from oracle import mismatch

SF = "/root/testdata/sf0.001"
MODULES = ["problems", "search", "corpus", "operations"]
QUERIES = {n: (f, m.ORACLE.get(n)) for m in (importlib.import_module(f"silverloom.plans.{x}") for x in MODULES) for n, f in m.QUERIES.items()}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    query, sql = QUERIES[name]
    if sql is None:
        assert query(spark, SF).count() >= 0
    else:
        assert mismatch(spark, name, query, sql, SF) == ""


def test_no_sql_without_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p2_found", "p5_found"} <= set(entry.queries())
