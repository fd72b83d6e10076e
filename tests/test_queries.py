"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check import TABLES, compare
from pressmill.workload import REGISTERED

SF = "/root/testdata/sf0.001"
BLUEPRINT = {
    "S": 5, "R": 9, "V": 5, "C": 12, "T": 4, "M": 5, "E": 11, "A": 14, "L": 6, "J": 5, "K": 11, "B": 8, "ST": 10, "U": 2,
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(REGISTERED))
def test_query_equals_sql(spark, con, name):
    text, _, ok = compare(spark, con, name, REGISTERED[name].run, REGISTERED[name].sql, SF)
    assert ok, text


def test_every_operator_has_a_query():
    covered = {c for q in REGISTERED.values() for c in re.findall(r"[A-Z]+\d+", q.covers)}
    wanted = {f"{k}{i}" for k, n in BLUEPRINT.items() for i in range(1, n + 1)}
    assert wanted - covered == set()


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
