"""Every registered query beside its SQL, at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sql, name):
    verdict, _, _ = compare(spark, sql, SF, name)
    if name in ORACLE:
        assert verdict == ""
    else:
        assert verdict.startswith("rows only: ") and verdict != "rows only: 0"


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(QUERIES)
    df = entry.entry(spark)
    assert df.columns == ["id", "prediction"] and df.count() > 0
