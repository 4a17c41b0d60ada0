import pytest

from oracle import compare
from tessera.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    if name in ORACLE_SQL:
        assert compare(spark, QUERIES[name], ORACLE_SQL[name], SF) is None
    else:
        assert QUERIES[name](spark, SF).count() > 0
