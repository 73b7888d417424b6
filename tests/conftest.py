import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortlens.session import build_session  # noqa: E402
from cohortlens.sources import schemas  # noqa: E402
from cohortlens.sources.tables import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    warehouse = tempfile.mkdtemp(prefix="cohortlens-warehouse-", dir=os.environ.get("TMPDIR", "/tmp"))
    s = build_session("local[4]", shuffle_partitions=8, app_name="cohortlens-tests",
                      extra={"spark.sql.warehouse.dir": warehouse})
    yield s
    s.stop()


def D(s):
    return dt.date.fromisoformat(s)


def make_tables(spark, users=(), services=(), app=(), campaigns=(), responses=()):
    """Tables from plain tuples in schema column order."""
    def df(rows, schema):
        return spark.createDataFrame(list(rows), schema)
    return Tables(users=df(users, schemas.USERS), services=df(services, schemas.SERVICES),
                  app_usage=df(app, schemas.APP_USAGE), campaigns=df(campaigns, schemas.CAMPAIGNS),
                  responses=df(responses, schemas.RESPONSES))


def user(uid, age=30, income="Middle", region="South"):
    return (uid, age, "Female", "Employed", income, region, "City", 2)


def svc(uid, sid, start, end=None, fee=10.0, kind="Vaccination", channel="Direct Digital"):
    return (uid, sid, D(start), D(end) if end else None, fee, kind, channel)


def app_row(uid, last, minutes=10.0, spend=5.0):
    return (uid, minutes, "Low", spend, 3, "PayPal", D(last) if last else None)
