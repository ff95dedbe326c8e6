"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"
# The smallest cube has five time steps, less than these need for one row.
TOO_SHORT = {"frame_limits", "lag_stack", "stream_lag_stack", "stream_window_mean", "tendency_frames"}


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_its_sql(spark, name):
    assert compare(spark, name, FOLDER) == ("no rows" if name in TOO_SHORT else None)


def test_every_check_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert [r.plevel for r in rows] == list(range(7))
