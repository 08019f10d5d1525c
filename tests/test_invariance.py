"""Results must not depend on how Spark cuts, shuffles or joins the data."""

import pytest

from planes.plans.queries import QUERIES
from planes.session import shared_dir
from planes.streaming.axes import Folders
from tests.test_oracle import rows

SMALL_DIR = "/root/testdata/sf0.001"

# One task per few kilobytes, an odd number of shuffle partitions, no adaptive changes and
# sort-merge joins only.
OTHER_PLAN = {
    "spark.sql.files.maxPartitionBytes": "20000",
    "spark.sql.shuffle.partitions": "3",
    "spark.sql.adaptive.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


def result(spark, name):
    df = QUERIES[name](spark, SMALL_DIR)
    return rows(df.columns, [tuple(r) for r in df.collect()])


@pytest.mark.parametrize("name", sorted(QUERIES))
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


def plans_run(spark, job):
    """The plans of all that ``job`` runs, jobs that build a query included."""

    def plans():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = spark._jsparkSession.sharedState().statusStore().executionsList()
        each = [found.apply(i) for i in range(found.size())]
        return {e.executionId(): e.physicalPlanDescription() for e in each}

    last = max(plans(), default=-1)
    job()
    return [plan for number, plan in plans().items() if number > last]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_have_no_cross_joins_or_python(spark, name):
    plans = plans_run(spark, lambda: QUERIES[name](spark, SMALL_DIR).write.format("noop").mode("overwrite").save())
    assert plans
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert not any(operator in plan for plan in plans)


def test_shared_folder_is_stable_and_used(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert Folders.shared(spark, "usage").checkpoint == f"{shared_dir(spark)}/usage/checkpoint"
