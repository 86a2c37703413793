"""Plans of the queries that stand on boxes and features."""

import pytest

from gridfill.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["p15_known_missing", "j2_boxes_with_values", "j3_boxes_to_search", "j11_fill_missing", "a4_count_missing", "a13_grid_rows", "m2_register", "m6_start_result"])
def test_no_cartesian_join(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
