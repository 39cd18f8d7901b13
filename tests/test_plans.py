"""Physical plans: columns are pruned, ranks are limited before shuffles, nothing runs in Python."""

import pytest

from sluice.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"
IN_PYTHON = {"gbk_roundtrip", "format_detect"}


def plan(spark, name):
    return QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - IN_PYTHON))
def test_no_python_in_the_plan(spark, name):
    text = plan(spark, name)
    assert "EvalPython" not in text and "InArrow" not in text and "InPandas" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_columns_are_pruned(spark):
    text = plan(spark, "join_inner")
    assert "c_name" in text and "c_acctbal" not in text and "o_totalprice" not in text
    assert "html" not in plan(spark, "path_parts")


@pytest.mark.parametrize("name", ["dedup_line", "dedup_last", "dedup_columns", "dedup_last_in_place"])
def test_first_of_a_key_is_limited_in_each_task(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


def test_counts_are_aggregated_before_the_shuffle(spark):
    for name in ("dedup_counts", "column_profile", "clean_counts"):
        assert "partial_" in plan(spark, name)
