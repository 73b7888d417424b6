"""Persisted frames have an owner and go with it."""

import os

import pytest
from pyspark.sql import functions as F

from cohortlens.config import TESTDATA
from cohortlens.operators import attribution
from cohortlens.plans import catalog, reports
from cohortlens.scope import Scope, default_scope, keep
from cohortlens.sources import testdata
from cohortlens.sources.tables import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def nothing_cached(spark):
    default_scope.release()
    spark.catalog.clearCache()


def cached(spark):
    return not spark._jsparkSession.sharedState().cacheManager().isEmpty()


@pytest.mark.parametrize("report", [
    lambda t: reports.churn_table(t, TESTDATA), lambda t: reports.region_report(t, TESTDATA),
    lambda t: reports.age_report(t, TESTDATA), lambda t: reports.rfm_table(t, TESTDATA),
    lambda t: reports.segment_reports(t, TESTDATA)["age"],
    lambda t: reports.status_profile(reports.churn_table(t, TESTDATA), TESTDATA),
    lambda t: attribution.attribution_base(t.campaigns, t.responses, t.services, TESTDATA)])
def test_nothing_stays_cached_after_a_report(spark, report):
    t = testdata.load(spark, SF)
    with Scope():
        rows = sorted(map(repr, report(t).collect()))
        assert cached(spark)
    assert not cached(spark) and rows == sorted(map(repr, report(t).collect()))


def test_scopes_nest_and_release_on_errors(spark):
    with Scope():
        outer = keep(spark.range(3))
        with pytest.raises(ZeroDivisionError), Scope():
            inner = keep(spark.range(4))
            raise ZeroDivisionError
        assert outer.storageLevel.useMemory and not inner.storageLevel.useMemory
    assert not cached(spark)


def test_a_query_releases_the_one_before(spark):
    first = catalog.queries()["churn_table"](spark, SF)
    assert cached(spark)
    catalog.queries()["null_profile_users"](spark, SF)
    assert not cached(spark) and first.count() > 0   # computed again


def test_all_analyses_are_written_from_one_sequence(spark, tmp_path):
    base = testdata.load(spark, SF)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    services = base.services.mapInArrow(counted, base.services.schema)
    t = Tables(base.users, services, base.app_usage, base.campaigns, base.responses)
    with Scope():
        parts = reports.churn_parts(t, TESTDATA)
        for df in (parts["sequence"], parts["cutoffs"], parts["service_churn"], parts["service_summary"],
                   reports.churn_table(t, TESTDATA, parts)):
            df.write.format("noop").mode("overwrite").save()
    n = base.services.count()
    assert n <= read.value <= 2 * n      # the sequence, and the count of hot users before it
    names = reports.write_analyses(base, str(tmp_path / "out"), TESTDATA)
    assert not cached(spark) and sorted(names) == sorted(os.listdir(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out" / "churn_table"))
    assert out.count() == base.users.count() and "All_Service_Types" not in out.columns
    assert spark.read.parquet(str(tmp_path / "out" / "service_history_chunks")).agg(F.sum("Services")).first()[0] \
        == spark.read.parquet(str(tmp_path / "out" / "sequence")).count()
