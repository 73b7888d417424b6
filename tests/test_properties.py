"""Properties of whole-table results."""

import pytest
from pyspark.sql import functions as F

from cohortlens.config import TESTDATA
from cohortlens.plans import reports
from cohortlens.sources import testdata
from cohortlens.sources.tables import Tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def t(spark):
    return testdata.load(spark, SF)


def test_attribution_credits_once(t):
    a = reports.attribution_table(t, TESTDATA)
    conv = a.where(F.col("Converted") == 1)
    assert conv.groupBy("Service_ID").count().where(F.col("count") > 1).count() == 0
    assert a.groupBy("Campaign_ID", "User_ID").count().where(F.col("count") > 1).count() == 0
    gap = F.datediff("ServiceStartDate", "OutreachDate")
    assert conv.where((gap < 0) | (gap > TESTDATA.attribution_days)).count() == 0
    assert a.where((F.col("Converted") == 0) & F.col("Service_ID").isNotNull()).count() == 0


def test_statuses_partition_users_and_one_row_per_user(t):
    ct = reports.churn_table(t, TESTDATA)
    n_users = t.users.count()
    assert ct.count() == n_users == ct.select("User_ID").distinct().count()
    shares = {r.UserStatus for r in ct.select("UserStatus").distinct().collect()}
    assert shares <= {"Service and App", "Services Only", "App Only", "Inactive"}
    rfm = reports.rfm_table(t, TESTDATA)
    assert rfm.count() == n_users
    scores = rfm.where(F.col("RFM_Score_Service").isNotNull()).agg(
        F.min("RFM_Score_Service").alias("lo"), F.max("RFM_Score_Service").alias("hi")).collect()[0]
    assert 3 <= scores.lo <= scores.hi <= 15


def _rows(df):
    return sorted(tuple(repr(v) for v in r) for r in df.collect())


def test_row_order_independence(spark):
    base = testdata.load(spark, "/root/testdata/sf0.001")
    shuffled = Tables(users=base.users.orderBy(F.col("User_ID").desc()),
                      services=base.services.repartition(7, "Service_ID").orderBy(F.xxhash64("Service_ID")),
                      app_usage=base.app_usage.repartition(3), campaigns=base.campaigns.orderBy(F.rand(7)),
                      responses=base.responses.repartition(5).orderBy(F.col("Campaign_ID").desc()))
    for build in (lambda x: reports.churn_table(x, TESTDATA).withColumn("All_Service_Types", reports.history_text()),
                  lambda x: reports.rfm_table(x, TESTDATA),
                  lambda x: reports.attribution_table(x, TESTDATA),
                  lambda x: reports.region_report(x, TESTDATA, ordered=False)):
        assert _rows(build(base)) == _rows(build(shuffled))


def test_segment_reports_share_intermediates(spark, t):
    both = reports.segment_reports(t, TESTDATA)
    assert _rows(both["region"]) == _rows(reports.region_report(t, TESTDATA))
    assert _rows(both["age"]) == _rows(reports.age_report(t, TESTDATA))


def test_contracts(spark, t):
    reports.check_contracts(t)
    dup = Tables(users=t.users, services=t.services, app_usage=t.app_usage.unionByName(t.app_usage.limit(1)),
                 campaigns=t.campaigns, responses=t.responses)
    with pytest.raises(ValueError):
        reports.check_contracts(dup)


def test_disk_only_storage_gives_same_tables(spark):
    small = testdata.load(spark, "/root/testdata/sf0.001")
    disk = TESTDATA.with_(storage_level="DISK_ONLY")
    ct = lambda p: reports.churn_table(small, p).withColumn("All_Service_Types", reports.history_text())
    assert _rows(ct(disk)) == _rows(ct(TESTDATA))
    assert _rows(reports.rfm_table(small, disk)) == _rows(reports.rfm_table(small, TESTDATA))
