"""Plan guards over the whole query registry: no cross joins, no row-at-a-time Python."""
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]
NAMES = [n for n in E.queries() if not n.startswith(("ml_", "op")) and n != "pipeline"]   # these store tables while planning


@pytest.mark.parametrize("name", NAMES)
def test_query_plan_has_no_cross_join_or_row_udf(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, (name, op)
