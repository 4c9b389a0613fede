"""A few registered queries beside their checking SQL; ``check.py`` compares all of them."""
import os

import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not present")
@pytest.mark.parametrize("name", ["fold_suppliers", "parent_rollup", "segment_breakdown", "candidate_codes", "align_results", "rate_window", "upsert_suppliers"])
def test_matches_sql(spark, name):
    ok, note = check.compare(spark, FOLDER, name)
    assert ok, note


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not present")
def test_flagship(spark):
    assert 0 < entry.entry(spark).count() <= 10


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
