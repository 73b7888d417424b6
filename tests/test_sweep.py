"""The attribution sweep against the ranks, and what its plan may hold."""

import random

import pytest

from cohortlens.operators import attribution
from cohortlens.plans import catalog
from conftest import D, make_tables, svc
from test_verdict_cases import attribution_by_ranks, campaign


def touches_and_services(spark, seed, days, users=9, campaigns=20, services=120):
    rng = random.Random(seed)
    day = lambda: f"20{20 + (d := rng.randrange(days)) // 336:02d}-{1 + d % 336 // 28:02d}-{1 + d % 28:02d}"
    return make_tables(
        spark, campaigns=[campaign(k, day()) for k in range(campaigns)] + [(900, "SMS", None, 1.0, "General")],
        responses=[(u, k, 1, 0.5, 1) for u in [*range(users), None] for k in [*range(campaigns), 900] if rng.random() < 0.6],
        services=[svc(rng.randrange(users + 1), s, day()) for s in range(services)]
        + [(None, 7001, D("2020-01-05"), None, 1.0, "Vaccination", "X"), (1, 7002, None, None, 1.0, "Vaccination", "X")])


@pytest.mark.parametrize("range_days,days", [(366, 28), (31, 120), (40, 900), (1, 60), (366, 1500)])
def test_sweep_equals_the_ranks(spark, monkeypatch, range_days, days):
    """Short ranges put the window across their borders."""
    monkeypatch.setattr(attribution, "RANGE_DAYS", range_days)
    t = touches_and_services(spark, days, days)
    got = attribution.attribution(t.campaigns, t.responses, t.services).collect()
    assert sorted(map(repr, got)) == attribution_by_ranks(t)
    assert {r.User_ID for r in got} >= {None} and any(r.OutreachDate is None for r in got)


def test_sweep_equals_the_join_of_days(spark, monkeypatch):
    monkeypatch.setattr(attribution, "RANGE_DAYS", 31)
    t = touches_and_services(spark, 5, 200, campaigns=60)
    pairs = attribution.campaign_pairs(t.campaigns, t.responses)
    joined = {(r.User_ID, r.OutreachDate): r for r in attribution.touch_matches(pairs, t.services).collect()}
    from cohortlens.config import DEFAULT
    rows = attribution._swept(pairs, t.services, DEFAULT).collect()
    assert len(rows) == pairs.count() and {(r.User_ID, r.OutreachDate) for r in rows if r._s} == set(joined)
    for r in rows:
        if r._s:
            other = joined[r.User_ID, r.OutreachDate]
            assert r._s == other._s and r._first_touch == (other._credit == r.Campaign_ID)


def test_repeated_campaigns_among_others(spark):
    """Dates that repeat with other attributes, and a later date with a service
    of its own."""
    rows = [campaign(1, "2024-01-01"), campaign(1, "2024-01-01", "Email"), campaign(1, "2024-03-01"), campaign(2, "2024-01-05"),
            campaign(3, "2024-02-25"), campaign(4, "2024-06-01"), campaign(4, "2024-01-02")]
    t = make_tables(spark, campaigns=rows, responses=[(u, c, 1, 0.5, 1) for u in (5, 6) for c in (1, 2, 3, 4)],
                    services=[svc(5, 50, "2024-01-10"), svc(5, 51, "2024-03-05"), svc(6, 60, "2024-06-15"), svc(6, 61, "2024-01-03")])
    got = {(r.Campaign_ID, r.User_ID): (r.OutreachType, str(r.OutreachDate), r.Service_ID)
           for r in attribution.attribution(t.campaigns, t.responses, t.services).collect()}
    # a date without a service comes first, then the first service that no earlier touch has
    assert got == {(1, 5): ("Email", "2024-01-01", 50), (3, 5): ("SMS", "2024-02-25", 51), (4, 5): ("SMS", "2024-06-01", None),
                   (1, 6): ("SMS", "2024-03-01", None), (2, 6): ("SMS", "2024-01-05", None), (3, 6): ("SMS", "2024-02-25", None)}


def test_every_source_is_read_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("attribution", "conversion_rate"):
            df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") <= 8 and plan.count("SortMergeJoin") == 2
            assert plan.count("+- Window ") == 1
            assert plan.count("FileScan parquet") == 4  # orders is read as services and for the responses' users
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
