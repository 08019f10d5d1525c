"""Plans of the queries, and results that must not depend on them."""

import pytest

import corpus_pipeline
from planes.llm.queries import QUERIES
from tests.test_invariance import OTHER_PLAN, SMALL_DIR, plans_run
from tests.test_oracle import rows

ALL = {**QUERIES, "pipeline": corpus_pipeline.run}
NATIVE = {"op3_sharding"}


def result(spark, name):
    df = ALL[name](spark, SMALL_DIR)
    return rows(df.columns, [tuple(r) for r in df.collect()])


@pytest.mark.parametrize("name", sorted(ALL))
def test_same_rows_under_another_plan(spark, name):
    usual = result(spark, name)
    old = {key: spark.conf.get(key) for key in OTHER_PLAN}
    try:
        for key, value in OTHER_PLAN.items():
            spark.conf.set(key, value)
        other = result(spark, name)
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert usual == other


@pytest.mark.parametrize("name", sorted(ALL))
def test_plans_of_all_jobs(spark, name):
    """No job compares all rows with all, and native operators start no Python."""
    plans = plans_run(spark, lambda: ALL[name](spark, SMALL_DIR).write.format("noop").mode("overwrite").save())
    barred = ["CartesianProduct", "BroadcastNestedLoopJoin"]
    if name in NATIVE:
        barred += ["EvalPython", "InPandas", "InArrow", "Scan ExistingRDD"]
    assert plans
    for operator in barred:
        assert not any(operator in plan for plan in plans)
