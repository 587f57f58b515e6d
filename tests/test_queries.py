import pytest

from tests.oracle import DATA, compare
from textplan import io_queries  # noqa: F401  registers its queries
from textplan.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    compare(spark, f"{DATA}/sf0.001", QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", ["match_uptimeparse", "merge_window"])
def test_one_file_is_dealt_out(spark, name):
    """Rows of a table in one file are parsed by all cores, not by the task that reads them."""
    plan = QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan
