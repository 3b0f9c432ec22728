"""Every query of the subpackage that has SQL against it, and the native plans."""

import re

import pytest

from govlake.llm import queries

from .. import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    oracle.same(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLES[name])


@pytest.mark.parametrize("name", ["op1_url_filter", "op3_mixing", "op9_exact_dedup"])
def test_native_plans_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoopJoin", plan)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_plans_read_named_columns_only(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and ("n_chars" not in plan or name == "op12_merkle_manifest") and "CartesianProduct" not in plan
