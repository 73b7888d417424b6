"""Cases in which a cut, a cap or a repeated key would change a result."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import money_sum
from cohortlens.operators import attribution, churn, ordered, sequence
from cohortlens.operators.selection import group_median
from cohortlens.plans import catalog, reports
from conftest import D, app_row, make_tables, svc, user

SF = "/root/testdata/sf0.01"


def test_fees_below_a_cent_count(spark):
    t = make_tables(spark, services=[svc(1, k, "2024-01-01", fee=0.004) for k in range(5)])
    assert float(t.services.agg(money_sum("ServiceFee").alias("s")).first().s) == 0.02
    assert sequence.service_summary(sequence.service_sequence(t.services)).first().Total_Service_Fee == 0.02


def campaign(cid, day, kind="SMS"):
    return (cid, kind, D(day), 10.0, "General")


def test_repeated_campaign_gives_one_row(spark):
    t = make_tables(spark, campaigns=[campaign(1, "2024-01-01"), campaign(1, "2024-01-05"), campaign(2, "2024-01-03")],
                    responses=[(5, 1, 1, 0.5, 1), (5, 2, 1, 0.5, 1), (6, 1, 1, 0.5, 1)],
                    services=[svc(5, 50, "2024-01-10"), svc(5, 51, "2024-01-20")])
    got = {(r.Campaign_ID, r.User_ID): r for r in attribution.attribution(t.campaigns, t.responses, t.services).collect()}
    assert set(got) == {(1, 5), (1, 6)}
    assert got[1, 5].Service_ID == 50 and got[1, 5].OutreachDate == D("2024-01-01") and got[1, 6].Converted == 0


def attribution_by_ranks(t):
    base = attribution.attribution_base(t.campaigns, t.responses, t.services)
    keep = base.where("Campaign_Service_Rank = 1 AND (Service_ID IS NULL OR User_Service_Rank = 1)")
    return sorted(map(repr, keep.drop("Campaign_Service_Rank", "User_Service_Rank").collect()))


def test_day_level_attribution_equals_the_ranks(spark):
    rng = random.Random(3)
    day = lambda: f"2024-0{rng.randrange(1, 4)}-{rng.randrange(1, 29):02d}"
    t = make_tables(spark, campaigns=[campaign(k, day()) for k in range(25)],
                    responses=[(u, k, 1, 0.5, 1) for u in range(12) for k in range(25) if rng.random() < 0.5],
                    services=[svc(rng.randrange(12), s, day()) for s in range(150)])
    got = attribution.attribution(t.campaigns, t.responses, t.services)
    assert sorted(map(repr, got.collect())) == attribution_by_ranks(t)


def test_attribution_work_is_linear_in_a_users_history(spark):
    """1,000 touches and 1,000 services of one user inside one window."""
    t = make_tables(spark, campaigns=[campaign(k, f"2024-01-{1 + k % 28:02d}") for k in range(1000)],
                    responses=[(1, k, 1, 0.5, 1) for k in range(1000)],
                    services=[svc(1, s, f"2024-01-{1 + s % 28:02d}") for s in range(1000)])
    pairs = attribution.campaign_pairs(t.campaigns, t.responses)
    assert attribution.touch_matches(pairs, t.services).count() == 28
    got = attribution.attribution(t.campaigns, t.responses, t.services)
    assert [(r.Campaign_ID, r.Service_ID) for r in got.collect()] == [(0, 0)]   # the first touch has every later service
    plan = attribution.touch_matches(pairs, t.services)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join", plan.index("Aggregate"))


def test_group_median(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), float(rng.randrange(40)), 0) for _ in range(3001)] + [("c", None, 0), (None, 4.0, 0), (None, 5.0, 0)]
    df = spark.createDataFrame(rows, "k string, v double, x int")
    for accuracy in (10_000, 20):
        got = {r.k: r.m for r in group_median(df, "k", "v", "m", accuracy).collect()}
        assert got == {k: statistics.median_low([v for q, v, _ in rows if q == k]) if k != "c" else None for k in ("a", "b", "c", None)}


def test_many_hot_keys_and_ties(spark):
    """100 hot keys, one of them all ties: none is left whole."""
    df = spark.range(12_000).select(
        F.when(F.col("id") < 3000, F.lit(0)).otherwise(F.col("id") % 100).alias("u"), F.col("id").alias("q"),
        F.when(F.col("id") < 3000, F.lit(1)).otherwise(F.pmod(F.xxhash64("id"), F.lit(40)).cast("int")).alias("d"))
    hot = ordered.hot_keys(df, "u", hot_rows=50)
    assert len(hot) == 100
    split = ordered.group_window(df, "u", ["d"], lag=["d"], hot=hot, rows_per_part=100)
    assert split.columns == [*df.columns, "_rn", "_prev_d", "_is_last"]
    for u, n in hot:
        own = sorted(split.where(F.col("u") == u).select("_rn", "d", "_prev_d", "_is_last").collect())
        assert [r._rn for r in own] == list(range(1, n + 1)) and [r._is_last for r in own] == [False] * (n - 1) + [True]
        assert [r.d for r in own] == sorted(r.d for r in own) and [r._prev_d for r in own[1:]] == [r.d for r in own[:-1]]
    windows = split._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in windows and "_tie" in windows


def test_cutoff_join_without_ordinal_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("region_report", "churn_criteria", "churn_by_customer", "churn_table"):
            df = catalog.queries()[name](spark, SF)
            plan = df._jdf.queryExecution().executedPlan().toString()
            lines = plan.splitlines()
            for line, below in zip(lines, lines[1:]):
                if "Exchange hashpartitioning(" in line:
                    keys = line.partition("hashpartitioning(")[2]
                    # only the cutoffs' own aggregation, combined before, is dealt by the ordinal
                    assert not keys.startswith("Service_Quantity") or "partial_" in below
                    assert "Total_Services" not in keys
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.catalog.clearCache()


@pytest.mark.parametrize("bound", [0, 500_000])
def test_salted_and_broadcast_cutoffs_agree(spark, monkeypatch, bound):
    t = make_tables(spark, services=[svc(u, 100 * u + k, f"2024-0{1 + k}-0{1 + u % 9}") for u in range(20) for k in range(1 + u % 6)])
    cad = sequence.service_cadence(t.services)
    want = sorted(map(repr, churn.churn_criteria(cad, churn.gap_cutoffs(cad)).collect()))
    monkeypatch.setattr(churn, "BROADCAST_CUTOFFS", bound)
    assert sorted(map(repr, churn.churn_criteria(cad, churn.gap_cutoffs(cad)).collect())) == want


def test_history_needs_no_array(spark):
    plan = catalog.queries()["service_history"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    plan = catalog.queries()["status_share"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_repeated_keys_fail_loudly(spark):
    t = make_tables(spark, users=[user(1)], app=[app_row(1, "2024-01-01"), app_row(1, "2024-01-02")])
    with pytest.raises(ValueError):
        reports.rfm_parts(t)
    t = make_tables(spark, campaigns=[campaign(1, "2024-01-01"), campaign(1, "2024-01-02")])
    with pytest.raises(ValueError):
        reports.check_contracts(t)


def test_oracle_imports_nothing_it_checks():
    import cohortlens.plans.oracle as oracle
    assert "cohortlens" not in open(oracle.__file__).read()
