"""Operators that SQL can express, against their SQL."""

from __future__ import annotations

import pytest

from panelforge.llm import queries as llm_queries
from tests.oracle import connect, difference


@pytest.fixture(scope="module")
def con():
    return connect("/root/testdata/sf0.01")


@pytest.mark.parametrize("name", list(llm_queries.oracle_sql()))
def test_query_against_sql(spark, con, name):
    assert difference(llm_queries.queries()[name](spark, "/root/testdata/sf0.01"), llm_queries.oracle_sql()[name], con) == ""
