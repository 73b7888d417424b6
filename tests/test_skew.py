"""End to end with one user holding a third of all services: the hot-user
split (auto-detected) gives the same churn table and reports as the plain
per-user windows."""

import pytest
from pyspark.sql import functions as F

from cohortlens.config import TESTDATA
from cohortlens.operators import ordered
from cohortlens.plans import reports
from cohortlens.sources import testdata
from cohortlens.sources.tables import Tables


def _rows(df):
    return sorted(tuple(repr(v) for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    t = testdata.load(spark, "/root/testdata/sf0.01")
    hot_user = F.when(F.col("Service_ID") % 3 == 0, F.lit(1)).otherwise(F.col("User_ID"))
    return Tables(users=t.users, services=t.services.withColumn("User_ID", hot_user),
                  app_usage=t.app_usage, campaigns=t.campaigns, responses=t.responses)


def _build(t):
    return {
        "churn": reports.churn_table(t, TESTDATA).withColumn("All_Service_Types", reports.history_text()),
        "region": reports.region_report(t, TESTDATA, ordered=False),
    }


def test_hot_user_split_matches_plain(spark, skewed, monkeypatch):
    n_hot = skewed.services.where(F.col("User_ID") == 1).count()
    assert n_hot >= 0.3 * skewed.services.count()            # about a third of all rows
    monkeypatch.setattr(ordered, "HOT_ROWS", 10 ** 12)        # nobody is hot: plain windows
    plain = {k: _rows(v) for k, v in _build(skewed).items()}
    spark.catalog.clearCache()
    monkeypatch.setattr(ordered, "HOT_ROWS", 200)             # user 1 is hot: split over parts
    monkeypatch.setattr(ordered, "ROWS_PER_PART", 100)
    assert ordered.hot_keys(skewed.services, "User_ID")[0][0] == 1
    split = {k: _rows(v) for k, v in _build(skewed).items()}
    assert split == plain


def test_attribution_ranks_split_matches_plain(spark, monkeypatch):
    from cohortlens.operators import attribution
    t = testdata.load(spark, "/root/testdata/sf0.01")
    build = lambda: attribution.attribution_base(t.campaigns, t.responses, t.services, TESTDATA)
    monkeypatch.setattr(ordered, "HOT_ROWS", 10 ** 12)
    plain = _rows(build())
    spark.catalog.clearCache()
    monkeypatch.setattr(ordered, "HOT_ROWS", 25)      # users with many unmatched pairs become hot
    monkeypatch.setattr(ordered, "ROWS_PER_PART", 40)
    split_df = build()
    unmatched = split_df.where("Service_ID IS NULL").select("User_ID", "Service_ID")
    assert ordered.hot_keys(unmatched, ["User_ID", "Service_ID"], hot_rows=25)   # (user, NULL) groups are hot
    assert _rows(split_df) == plain
