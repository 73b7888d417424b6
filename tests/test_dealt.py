"""Rows of one task: the responses are dealt by rows, not only by bytes."""

from pyspark.sql import functions as F

from cohortlens.operators import attribution
from cohortlens.sources import testdata
from test_verdict_cases import campaign


def sources(spark):
    """Pairs that repeat over and within orders, null keys and an order key that occurs twice."""
    orders = [(k, k % 50 if k % 41 else None) for k in range(600)] + [(7, 3), (None, 9)]
    lines = [(k % 605 if k % 59 else None, k * 7 % 30 if k % 67 else None, float(k % 5), k % 10 / 100, "RAN"[k % 3]) for k in range(4000)]
    lines += [(5, 1, 1.0, 0.5, "A")] * 300
    return (spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double, l_discount double, l_returnflag string"),
            spark.createDataFrame(orders, "o_orderkey long, o_custkey long"))


def test_responses_are_dealt_by_rows_with_the_same_result(spark, monkeypatch):
    lineitem, orders = sources(spark)
    plain = testdata.responses(lineitem, orders)
    monkeypatch.setattr(testdata, "ROWS_PER_PART", 100)
    dealt = testdata.responses(lineitem, orders)
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, plain.collect()))
    campaigns = spark.createDataFrame([campaign(k, "2024-01-05") for k in range(30)],
                                      "Campaign_ID long, OutreachType string, OutreachDate date, OutreachBudget double, TargetSegment string")
    pairs = attribution.campaign_pairs(campaigns.hint("broadcast"), dealt)
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 35 and max(sizes) <= 100   # 43 parts; one coalesced part holds them all otherwise
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "Exchange hashpartitioning(User_ID" not in plan
    assert pairs.agg(F.sum("EngagementCount")).first()[0] == plain.where("Campaign_ID IS NOT NULL").agg(F.sum("EngagementCount")).first()[0]


def test_small_responses_are_left_to_the_session(spark):
    plan = testdata.responses(*sources(spark))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan
