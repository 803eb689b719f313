"""Every registered query outside the llm subpackage against its SQL, or for rows where SQL has no form."""

from __future__ import annotations

import pytest

from oracle import connect, difference
from panelforge import queries as Q

SQL = Q.oracle_sql()
#: What has no result on the smallest tables: no feature set has the hundred complete rows that an elimination wants.
NOTHING_SMALL = {"m9_backward_elimination"}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, small, con, name):
    df = Q.queries()[name](spark, small)
    if name in SQL:
        assert difference(df, SQL[name], con) == ""
    elif name in NOTHING_SMALL:
        assert df.count() == 0
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["a1_a3_a5_j1_season_panel", "c7_c14_shrink", "m3_m4_chosen_penalty", "m9_two_features", "w7_w8_w9_w10_ranks"])
def test_query_on_more_rows(spark, name):
    """What only shows with more rows: averages on a rounding border, penalties chosen from enough rows, several buckets."""
    sf_dir = "/root/testdata/sf0.01"
    assert difference(Q.queries()[name](spark, sf_dir), SQL[name], connect(sf_dir)) == ""


@pytest.mark.parametrize("name", sorted(NOTHING_SMALL))
def test_result_on_more_rows(spark, name):
    assert Q.queries()[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
