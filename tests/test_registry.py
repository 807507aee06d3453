import pytest

import __spark_entry__ as entry
from tarn.plans.registry import ORACLE, QUERIES
from tests.oracle import compare


def test_entry(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    compare(spark, name, QUERIES[name], ORACLE[name], "/root/testdata/sf0.01")
