import pytest

import __spark_entry__ as entry
from oracle import connect, difference
from sigweave.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
# Queries whose plans must stay free of Python and of cross products.
SCORING = ["direction_instability_parts", "entity_geometry", "localization", "phenotype_projection", "auroc",
           "spearman_global_lines", "group_summary", "one_vs_rest_auroc", "band_join_pairs", "quartile_gates"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert difference(got, con.execute(SQL[name]).df()) is None  # every query has SQL of the same meaning


@pytest.mark.parametrize("name", SCORING)
def test_plan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInArrow"):
        assert word not in plan


def test_scan_is_pruned(spark):
    plan = QUERIES["group_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" in plan and "l_orderkey" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
