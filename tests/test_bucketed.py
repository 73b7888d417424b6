"""Base tables stored by user: no exchange on User_ID in the reports."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import segments, sequence
from cohortlens.plans import reports
from cohortlens.scope import Scope
from cohortlens.sources import bucketed, sinks, testdata
from cohortlens.sources.tables import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain(spark):
    return testdata.load(spark, SF)


@pytest.fixture(scope="module")
def stored(spark, plain):
    bucketed.save_bucketed_tables(plain, "stored", 6)
    return bucketed.read_bucketed_tables(spark, "stored")


@pytest.fixture
def shuffled_joins(spark):
    """Small tables would be broadcast, which hides the exchanges."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def engaged(t):
    p = reports.report_parts(t, ("Region", "IncomeBracket"))
    return segments.engaged_users(p["users"], None, None, None, None, core=p["core"])


def shuffles(plan):
    """The partitionings of all exchanges that ran, cached frames' included."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        below = [plan.executedPlan()]
    elif name.endswith("QueryStageExec"):
        below = [plan.plan()]
    elif name == "InMemoryTableScanExec":
        below = [plan.relation().cachedPlan()]
    elif name == "ReusedExchangeExec":
        below = [plan.child()]
    else:
        below = [seq.apply(k) for seq in (plan.children(), plan.subqueries()) for k in range(seq.size())]
    own = [plan.outputPartitioning().toString()] if name == "ShuffleExchangeExec" else []
    return own + [s for p in below for s in shuffles(p)]


def user_shuffles(df):
    plan = df._jdf.queryExecution().executedPlan()
    return [s for s in shuffles(plan) if s.startswith("hashpartitioning(User_ID")]


REPORTS = {"engaged": engaged, "rfm": reports.rfm_table, "churn": reports.churn_table}


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", REPORTS)
def test_reports_of_stored_tables_do_not_shuffle_users(plain, stored, shuffled_joins, name):
    with Scope():
        df = REPORTS[name](stored)
        got = rows(df)
        assert not user_shuffles(df)
    with Scope():
        df = REPORTS[name](plain)
        assert got == rows(df)
        assert user_shuffles(df)


def test_one_file_a_bucket_and_a_hot_user_over_several(spark, plain):
    many = plain.services.withColumn("User_ID", F.when(F.col("Service_ID") % 3 == 0, 1).otherwise(F.col("User_ID")))
    hot = Tables(**{**plain.as_dict(), "services": many})
    bucketed.save_bucketed_tables(hot, "hot", 5, rows_per_part=50, hot_rows=100)
    t = bucketed.read_bucketed_tables(spark, "hot")
    assert len(t.users.inputFiles()) == 5
    per_file = spark.read.parquet(*t.services.inputFiles()).where("User_ID = 1").groupBy(F.input_file_name()).count()
    per_file = [r["count"] for r in per_file.collect()]
    assert len(per_file) > 3 and max(per_file) < 0.5 * sum(per_file)
    found = sequence.hot_keys(t.services, "User_ID", 100)
    assert [k for k, _ in found] == [1]
    got = sequence.service_sequence(t.services, hot=found, bucketed=True)
    assert rows(got) == rows(sequence.service_sequence(many, hot=[]).select(got.columns))
    # the grouping of a hot user is spread, and then no scan is tied to buckets
    assert "Bucketed: false" in got._jdf.queryExecution().executedPlan().toString()


def test_layouts_that_differ_are_refused(spark, plain):
    bucketed.save_bucketed_tables(plain, "uneven", 4)
    sinks.save_as_table(plain.users, "uneven_users", "overwrite", (3, "User_ID"))
    with pytest.raises(ValueError, match="one number of buckets"):
        bucketed.read_bucketed_tables(spark, "uneven")
