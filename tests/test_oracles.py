import pytest

from veriloom.plans import oracles, queries
from veriloom.plans.flow_oracles import FLOW_ORACLES
from veriloom.plans.flow_queries import FLOW_QUERIES
from veriloom.plans.record_oracles import RECORD_ORACLES
from veriloom.plans.record_queries import RECORD_QUERIES

from .oracle import DATA, same

QUERIES, ORACLES = queries.QUERIES | RECORD_QUERIES | FLOW_QUERIES, oracles.ORACLES | RECORD_ORACLES | FLOW_ORACLES


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_duckdb(spark, name):
    same(QUERIES[name](spark, f"{DATA}/sf0.001"), ORACLES[name], "sf0.001")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
