import pytest

from tests.oracle import DATA, compare
from textplan.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, f"{DATA}/sf0.01", QUERIES[name], ORACLE_SQL[name])
