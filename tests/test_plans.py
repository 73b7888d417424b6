"""Physical-plan shape: the choices the design depends on."""

from cohortlens.operators import segments, sequence
from cohortlens.plans import reports
from cohortlens.sources import testdata

SF = "/root/testdata/sf0.001"


def _plan(df):
    df.collect()  # finalise adaptive plans
    return df._jdf.queryExecution().executedPlan().toString()


def test_status_has_no_nested_loop_join(spark):
    t = testdata.load(spark, SF)
    plan = _plan(segments.activity_status(t.users, t.services, t.app_usage))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def _ops(plan, name):
    return sum(1 for line in plan.splitlines() if line.lstrip(" :+-").startswith(name))


def test_sequence_single_window_and_exchange(spark):
    spark.catalog.clearCache()
    t = testdata.load(spark, SF)
    plan = sequence.service_sequence(t.services)._jdf.queryExecution().executedPlan().toString()
    assert _ops(plan, "Window ") == 1          # lag, lead, row_number, first, nth_value share one sort
    assert _ops(plan, "Exchange ") == 1        # merge grouping and window share the user partitioning
    assert "PushedFilters: []" in plan          # every order is a service


def test_rfm_has_no_single_partition_exchange(spark):
    t = testdata.load(spark, SF)
    assert "SinglePartition" not in _plan(reports.rfm_table(t))


def test_churn_table_has_no_cartesian_product(spark):
    t = testdata.load(spark, SF)
    plan = _plan(reports.churn_table(t))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_attribution_interval_join_is_equi_join(spark):
    t = testdata.load(spark, SF)
    plan = _plan(reports.attribution_table(t))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
