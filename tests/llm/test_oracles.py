"""The opN queries against SQL on the shared tables."""

import pytest
from oracle import compare, connect

from tracewright.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLE_SQL[name])


def test_all_are_registered():
    import __spark_entry__

    found = {int(n[2:].split("_")[0]) for n in __spark_entry__.queries() if n.startswith("op")}
    assert found == set(range(1, 11)) and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", ["op1_mixing", "op2_line_dedup", "op7_feistel"])
def test_native_plans(spark, name):
    plan = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
