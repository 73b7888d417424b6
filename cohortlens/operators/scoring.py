"""Recency / frequency / monetary scoring: two independent models, one from
service records and one from app usage, each scored into ``score_buckets``
tiles per dimension with the distributed n-tile (ties broken by User_ID)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.config import DEFAULT, MISSING_DATE, TABLE_LABELS, Params
from cohortlens.functions import as_date, days_between, money_sum
from cohortlens.operators.ntile import ntiles
from cohortlens.operators.segments import status_from_markers


def service_activity(services: DataFrame) -> DataFrame:
    """Per user: exact fee total, number of typed services and the latest of
    any start or end date (missing dates count as 1900-01-01)."""
    floor = as_date(MISSING_DATE)
    latest = F.greatest(F.coalesce("ServiceStartDate", floor), F.coalesce("ServiceEndDate", floor))
    return services.groupBy("User_ID").agg(
        money_sum("ServiceFee").cast("double").alias("Total_Service_Fee"),
        F.count("ServiceType").alias("Total_Number_of_Services"),
        F.max(latest).alias("Last_Service_Activity"))


def rfm_service(services: DataFrame, params: Params = DEFAULT, **ntile_kw) -> DataFrame:
    act = service_activity(services).withColumn(
        "Days_Since_Last_Service", days_between(as_date(params.service_as_of), "Last_Service_Activity"))
    ntile_kw.setdefault("persist", params.storage())
    return ntiles(act, [("R_Service", "Last_Service_Activity"), ("F_Service", "Total_Number_of_Services"),
                        ("M_Service", "Total_Service_Fee")], params.score_buckets, "User_ID", **ntile_kw)


def rfm_app(app_usage: DataFrame, params: Params = DEFAULT, **ntile_kw) -> DataFrame:
    app = app_usage.select(
        "User_ID", "AvgSessionMinutes", "TelehealthSpend", F.col("LastServiceDate").alias("Last_App_Activity"),
        days_between(as_date(params.app_as_of), "LastServiceDate").alias("Days_Since_Last_App"))
    ntile_kw.setdefault("persist", params.storage())
    return ntiles(app, [("R_App", "Last_App_Activity"), ("F_App", "AvgSessionMinutes"),
                        ("M_App", "TelehealthSpend")], params.score_buckets, "User_ID", **ntile_kw)


def _code(a, b, c):
    """``CONCAT`` of three scores, NULL if any is NULL."""
    return F.concat(F.col(a).cast("string"), F.col(b).cast("string"), F.col(c).cast("string"))


def rfm_table(users: DataFrame, service_rfm: DataFrame, app_rfm: DataFrame,
              labels: dict = TABLE_LABELS) -> DataFrame:
    """One row per user row: status, both RFM models and their inputs."""
    sr = service_rfm.withColumn("_svc", F.lit(True))
    ar = app_rfm.withColumn("_app", F.lit(True))
    j = users.select("User_ID").join(sr, "User_ID", "left").join(ar, "User_ID", "left")
    return j.select(
        "User_ID",
        status_from_markers(F.col("_svc").isNotNull(), F.col("_app").isNotNull(), labels).alias("UserStatus"),
        "R_Service", "F_Service", "M_Service",
        _code("R_Service", "F_Service", "M_Service").alias("RFM_Service"),
        (F.col("R_Service") + F.col("F_Service") + F.col("M_Service")).alias("RFM_Score_Service"),
        "Days_Since_Last_Service", "Total_Number_of_Services", "Total_Service_Fee",
        "R_App", "F_App", "M_App",
        _code("R_App", "F_App", "M_App").alias("RFM_App"),
        (F.col("R_App") + F.col("F_App") + F.col("M_App")).alias("RFM_Score_App"),
        "Days_Since_Last_App", "AvgSessionMinutes", "TelehealthSpend")


def rfm_distribution(service_rfm: DataFrame, app_rfm: DataFrame) -> DataFrame:
    """Users per (model, dimension, score) for both models."""
    def stacked(df, model, cols):
        return df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("Dimension"), F.col(c).alias("Score"))
                                             for d, c in cols])).alias("x")).select(
            F.lit(model).alias("Model"), "x.Dimension", "x.Score")
    rows = stacked(service_rfm, "Service", [("R", "R_Service"), ("F", "F_Service"), ("M", "M_Service")]).unionByName(
        stacked(app_rfm, "App", [("R", "R_App"), ("F", "F_App"), ("M", "M_App")]))
    return rows.groupBy("Model", "Dimension", "Score").agg(F.count(F.lit(1)).alias("Users"))
