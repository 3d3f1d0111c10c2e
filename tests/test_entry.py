"""Every query runs; the SQL names no query that is not there."""

import pytest

import __spark_entry__ as entry
from oppflow.plans import queries as plans


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(plans.QUERIES) >= 45


@pytest.mark.parametrize("name", ["page_text", "record_keys", "near_miss", "arrivals", "post_fingerprints", "tier_report"])
def test_query(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).columns == ["id_a", "id_b", "rule"]
