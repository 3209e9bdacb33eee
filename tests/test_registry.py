from pathlib import Path

import pytest

import __spark_entry__ as entry_points
import check
from newsloom.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_an_expected_result():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(QUERIES) <= set(entry_points.oracle_sql())


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    good, text = check.compare(spark, SMALL, name, check.connect(SMALL))
    assert good, text


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data")
def test_entry(spark):
    assert entry_points.entry(spark).columns == ["key", "doc_count", "score", "bg_count"]
