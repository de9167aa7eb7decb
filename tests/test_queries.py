"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from tests.compare import compare

FOLDER = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_gives_rows(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query_agrees_with_sql(spark, name):
    problem, _ = compare(
        spark, FOLDER, name, entry_points.queries()[name], entry_points.oracle_sql().get(name)
    )
    assert problem is None, problem
