"""The registered queries of the subpackage against their SQL."""

import pytest

from tarn.llm.registry import ORACLE, QUERIES
from tests.oracle import compare

pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", sorted(set(ORACLE) - {"op1_url_filter"}))
def test_against_sql(spark, name):
    compare(spark, name, QUERIES[name], ORACLE[name], "/root/testdata/sf0.01")
