import pytest
from oracle import same

from fundtrace.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_sql(spark, name):
    assert same(spark, SF, registry.queries()[name], registry.oracle_sql()[name]) > 0
