"""Every registered query of the pattern operators against its SQL, or, where it has none, that it gives rows."""

import pytest

from footfall.plans.registry import ORACLE_SQL, QUERIES
from tests.compare import same

FOLDER = "/root/testdata/sf0.001"
SLOW = {"validation_bundle", "strauss_refinement", "dgs_refinement", "dgs_cross_validation", "dpp_cross_validation", "dpp_refinement"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, name):
    if name in ORACLE_SQL:
        same(QUERIES[name], ORACLE_SQL[name], spark, FOLDER)
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", sorted(SLOW))
def test_composition(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
