"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

import re

import check_queries
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return check_queries.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    ok, note = check_queries.compare(spark, duck, name, QUERIES[name], SQL.get(name), SF_DIR)
    assert ok, note


def test_every_own_query_has_sql():
    own = {name for name in QUERIES if name != "pipeline" and not re.match(r"op\d+_", name)}
    assert own <= set(SQL)


def test_entry(spark):
    assert entry.entry(spark).count() == 36
