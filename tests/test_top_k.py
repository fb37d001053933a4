"""Top lists on tables that have more keys than ranks."""

import pytest

import __spark_entry__ as entry
from tests.harness import differences, duck

FOLDER = "/root/testdata/sf0.01"
LISTS = ("origin_month_matrix", "airport_activity", "top_airport_route_delay", "segment_worst_best", "travel_peaks", "route_volume_matrix")


@pytest.mark.parametrize("name", LISTS)
def test_as_many_ranks_as_the_reference(spark, name):
    assert differences(entry.queries()[name](spark, FOLDER), duck(FOLDER), entry.oracle_sql()[name]) == []
