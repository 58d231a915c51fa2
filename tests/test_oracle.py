"""Every named query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
# Too few rows at this scale for these conditions to select any.
MAY_BE_EMPTY = {"a35_dominant_name_batches", "x03_without_recent_run", "f20_client_filters", "o05_second_page"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    if name not in oracle_sql():
        assert df.columns
        df.count()
        return
    problem = compare(df, duck, oracle_sql()[name])
    assert problem is None or (problem == "EMPTY" and name in MAY_BE_EMPTY), problem


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_views_need_no_session():
    assert len(queries()) > 250
