import os

import pytest

FOLDER = "/root/testdata/sf0.001"
LAZY = (
    "mine_pages_funnel mine_claims_status membership_overlap take_per_source train_val_split waterfill_quotas "
    "time_islands running_baseline nearest_column_distance uncovered_lines block_first_line group_advantage "
    "group_softmax_risk symmetric_bond_classes sampled_triplets triplet_loss mass_composition label_topk audit_counts"
).split()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_joins_and_no_python(spark, name):
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in plan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
def test_filters_and_columns_reach_the_scan(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["allowed_orders"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in plan
