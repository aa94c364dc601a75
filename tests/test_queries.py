import pytest

import __spark_entry__ as entry
from feltloom.plans.queries import ORACLE_SQL, QUERIES

from compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    assert differences(spark, SF, name, QUERIES[name](spark, SF), ORACLE_SQL[name]) is None


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
