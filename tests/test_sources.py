"""CSV source with explicit schema on files of our own, the TESTDATA adapter
and the create-table-as sink."""

import os

import pytest
from pyspark.sql import functions as F

from cohortlens.operators.quality import assert_unique, key_uniqueness, null_profile
from cohortlens.sources import files, schemas, sinks, testdata

DATA = os.path.join(os.path.dirname(__file__), "data")   # header, CRLF, M/d/yy, the text None, no final newline


@pytest.fixture(scope="module")
def samples(spark):
    return files.read_csv_tables(spark, {name: f"{DATA}/{name}.csv" for name in schemas.BY_NAME})


def test_csv_rows_types_and_dates(samples):
    assert {k: df.count() for k, df in samples.as_dict().items()} == {
        "users": 3, "services": 3, "app_usage": 2, "campaigns": 2, "responses": 2}
    for name, df in samples.as_dict().items():
        assert df.schema == schemas.BY_NAME[name]
    s = samples.services.orderBy("Service_ID").collect()
    assert [r.ServiceStartDate.isoformat() for r in s] == ["2024-01-05", "2024-12-31", "2025-03-09"]
    assert s[0].ServiceEndDate.isoformat() == "2024-02-14" and s[1].ServiceFee == 0.004
    assert samples.app_usage.where(F.col("SpendingSegment") == "None").count() == 1   # a text, not a NULL


def test_csv_null_profile(samples):
    prof = null_profile(samples.services).collect()[0].asDict()
    assert prof["ServiceEndDate_nulls"] == 2 and sum(prof.values()) == 2
    for name in ("users", "app_usage", "campaigns", "responses"):
        assert sum(null_profile(getattr(samples, name)).collect()[0]) == 0


def test_csv_columns_in_another_order_fail(spark, tmp_path):
    path = tmp_path / "campaigns.csv"
    path.write_text("OutreachType,Campaign_ID,OutreachDate,OutreachBudget,TargetSegment\n9,7,1/1/25,50.5,General")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(path), "campaigns").collect()


def test_csv_malformed_value_fails(spark, tmp_path):
    path = tmp_path / "responses.csv"
    path.write_text("User_ID,Campaign_ID,ResponseFlag,CTR,EngagementCount\nx,7,1,0.25,3")
    with pytest.raises(Exception):
        files.read_csv(spark, str(path), "responses").collect()


def test_key_checks(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "User_ID long")
    r = key_uniqueness(df, "User_ID", "All_Users", "Distinct_Users").collect()[0]
    assert (r.All_Users, r.Distinct_Users) == (3, 2)
    with pytest.raises(ValueError):
        assert_unique(df, "User_ID")


def test_testdata_adapter_schemas(spark):
    t = testdata.load(spark, "/root/testdata/sf0.001")
    for name, df in t.as_dict().items():
        assert [f.name for f in df.schema] == [f.name for f in schemas.BY_NAME[name]]
    assert t.users.count() == t.users.select("User_ID").distinct().count()
    assert t.services.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()   # every order


def test_create_table_as_fails_when_present(spark, tmp_path):
    df = spark.range(3)
    path = str(tmp_path / "t")
    sinks.create_table_as(df, path)
    with pytest.raises(Exception):
        sinks.create_table_as(df, path)
    assert spark.read.parquet(path).count() == 3


def test_bucketed_user_tables_join_without_shuffle(spark):
    from cohortlens.config import TESTDATA
    from cohortlens.plans import reports
    t = testdata.load(spark, "/root/testdata/sf0.001")
    sinks.save_as_table(reports.churn_table(t, TESTDATA).drop("All_Service_Types"), "churn_b", mode="overwrite",
                        bucket_by=(8, "User_ID"))
    sinks.save_as_table(reports.rfm_table(t, TESTDATA), "rfm_b", mode="overwrite", bucket_by=(8, "User_ID"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("churn_b").join(spark.table("rfm_b").drop("UserStatus", "Total_Service_Fee",
                                                                 "Total_Number_of_Services"), "User_ID")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert j.count() == t.users.count()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_parquet_tables_round_trip(spark, tmp_path):
    from cohortlens.config import TESTDATA
    from cohortlens.plans import reports
    t = testdata.load(spark, "/root/testdata/sf0.001")
    for name, df in t.as_dict().items():
        sinks.create_table_as(df, str(tmp_path / name))
    back = files.read_parquet_tables(spark, str(tmp_path))
    key = lambda df: sorted(tuple(repr(v) for v in r) for r in df.collect())
    ct = lambda x: reports.churn_table(x, TESTDATA).withColumn("All_Service_Types", reports.history_text())
    assert key(ct(back)) == key(ct(t))
