"""Churn rules.

Cutoffs are per service ordinal across users: the ``cutoff_quantile`` of the
gap that ends at service *n* over all users reaching *n*. Service *n* is judged
by the cutoff of *n + 1*. Two rules exist and are kept apart on purpose:

* report rule (``churn_criteria``): 0 when cutoff > days, else 1, so a NULL
  cutoff or a tie gives 1;
* table rule (``service_churn``): 1 when days > cutoff, else 0, with a tiered
  level that falls back to the average cutoff when the ordinal has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.config import DEFAULT, STATUS_BOTH, STATUS_INACTIVE, TABLE_LABELS, Params
from cohortlens.functions import as_date, days_between, quantile


def gap_cutoffs(seq: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(Service_Quantity, P75_Gap): quantile of the gap ending at each ordinal.
    Ordinal 1 has no gap, so its cutoff is NULL."""
    return seq.groupBy("Service_Quantity").agg(
        quantile("Days_Since_Last_Service", params.cutoff_quantile, params.exact_quantiles,
                 params.approx_accuracy).cast("int").alias("P75_Gap"))


def _next_cutoff(cutoffs: DataFrame, name: str) -> DataFrame:
    """Cutoffs keyed by the ordinal they judge (n - 1): the shifted-key join
    becomes a plain equi join."""
    return cutoffs.select((F.col("Service_Quantity") - 1).alias("Service_Quantity"),
                          F.col("P75_Gap").alias(name))


#: Most cutoffs (one per ordinal, two numbers each) that are broadcast.
BROADCAST_CUTOFFS = 500_000


def _with_cutoff(rows: DataFrame, cutoffs: DataFrame, name: str) -> DataFrame:
    """``rows`` with the cutoff that judges their ordinal (NULL: none).

    There is one cutoff per ordinal, as many as the longest sequence has
    services.  Their number is looked up first: a table within the bound is
    broadcast, so the rows, of which the first ordinal holds one per user, are
    not shuffled on it.  A longer one is joined on (ordinal, salt), each cutoff
    repeated once per salt."""
    nxt = _next_cutoff(cutoffs, name).where(F.col("Service_Quantity") >= 1)
    if cutoffs.limit(BROADCAST_CUTOFFS + 1).count() <= BROADCAST_CUTOFFS:
        return rows.join(F.broadcast(nxt), "Service_Quantity", "left")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = F.pmod(F.xxhash64("User_ID"), F.lit(SALTS)).cast("int")
    return (rows.withColumn("_salt", salt)
            .join(nxt.withColumn("_salt", salts), ["Service_Quantity", "_salt"], "left").drop("_salt"))


SALTS = 64


def churn_criteria(cadence: DataFrame, cutoffs: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Report rule at service level: every cadence row with the window allowed
    for its next service and the 0/1 churn risk."""
    days = days_between(as_date(params.service_as_of), "ServiceStartDate")
    nxt = F.col("Next_Service_Within_Days")
    return (_with_cutoff(cadence, cutoffs, "Next_Service_Within_Days")
            .select("User_ID", "Service_ID", "ServiceStartDate", "Service_Quantity",
                    "Next_Service_Within_Days",
                    days.alias("Days_Since_Service"),
                    F.when(nxt > days, 0).otherwise(1).alias("Churn_Risk")))


def churn_by_customer(services: DataFrame | None, criteria: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Report rule at user level: the churn risk of the service whose ordinal
    equals the user's count of non-NULL service ids. ``totals`` (User_ID,
    Total_Services) may be passed when already computed."""
    if totals is None:
        totals = services.groupBy("User_ID").agg(F.count("Service_ID").alias("Total_Services"))
    # joins and aggregation run on User_ID alone, the partitioning that rows
    # and totals have; a filter on the ordinal would become a join key
    hit = F.col("Service_Quantity") == F.col("Total_Services")
    judged = criteria.select("User_ID", "Service_Quantity", "Churn_Risk").join(totals, "User_ID").groupBy("User_ID").agg(
        F.max(F.when(hit, F.col("Churn_Risk"))).alias("Churn_Risk"))
    return totals.join(judged, "User_ID", "left").select("User_ID", "Total_Services", "Churn_Risk")


def service_churn(seq: DataFrame, cutoffs: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Table rule per user, judged on the user's last service: binary flag
    and Low/Medium/High level. The average cutoff is a scalar subquery."""
    avg_cut = cutoffs.select(F.avg("P75_Gap")).scalar()
    # the reference finds the last service through an equi join on User_ID,
    # which drops services without a user
    last = seq.where(F.col("Is_Last") & F.col("User_ID").isNotNull()).select(
        "User_ID", "ServiceStartDate", "Service_Quantity")
    days = days_between(as_date(params.service_as_of), "ServiceStartDate")
    cut = F.col("Cutoff")
    level_cut = F.coalesce(cut.cast("double"), avg_cut)
    return (_with_cutoff(last, cutoffs, "Cutoff")
            .select("User_ID",
                    F.when(days > cut, 1).otherwise(0).alias("Service_Churn_Flag"),
                    F.when(days <= level_cut, "Low")
                     .when(days <= level_cut * F.lit(params.medium_factor), "Medium")
                     .otherwise("High").alias("Service_Churn_Level")))


def service_churn_per_user(seq: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Documented variant: the cutoff is the quantile of the user's own gaps
    (NULL for a one-service user, whose flag is then 0)."""
    own = seq.groupBy("User_ID").agg(
        quantile("Days_Since_Last_Service", params.cutoff_quantile, params.exact_quantiles,
                 params.approx_accuracy).cast("int").alias("Own_P75_Gap"),
        F.max("ServiceStartDate").alias("Last_Service_Start_Date"))
    days = days_between(as_date(params.service_as_of), "Last_Service_Start_Date")
    return own.select("User_ID", "Own_P75_Gap", days.alias("Days_Since_Last_Service"),
                      F.when(days > F.col("Own_P75_Gap"), 1).otherwise(0).alias("Service_Churn_Flag"))


def app_summary(app_usage: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return app_usage.select(
        "*", days_between(as_date(params.app_as_of), "LastServiceDate").alias("Days_Since_App_Activity"))


def app_churn_columns(days="Days_Since_App_Activity", params: Params = DEFAULT) -> dict:
    """{name: expression} of App_Churn_Flag and App_Churn_Level from days
    since the last app activity."""
    d = F.col(days) if isinstance(days, str) else days
    return {"App_Churn_Flag": F.when(d > params.app_high_days, 1).otherwise(0),
            "App_Churn_Level": F.when(d > params.app_high_days, "High")
                                .when(d > params.app_medium_days, "Medium").otherwise("Low")}


def app_churn(app_usage: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Fixed-threshold app churn per app user."""
    cols = [e.alias(n) for n, e in app_churn_columns(params=params).items()]
    return app_summary(app_usage, params).select("User_ID", "Days_Since_App_Activity", *cols)


def campaign_totals(responses: DataFrame) -> DataFrame:
    """Responses and engagements per user (pre-aggregated before any join)."""
    return responses.groupBy("User_ID").agg(
        F.sum("ResponseFlag").alias("Campaign_Responses"),
        F.sum("EngagementCount").alias("Campaign_Engagements"))


def final_churn_flag(status="UserStatus", service_flag="Service_Churn_Flag", app_flag="App_Churn_Flag",
                     labels: dict = TABLE_LABELS):
    s, sf, af = F.col(status), F.col(service_flag), F.col(app_flag)
    return (F.when(s == STATUS_INACTIVE, 1)
            .when((s == STATUS_BOTH) & (sf == 1) & (af == 1), 1)
            .when((s == labels["services"]) & (sf == 1), 1)
            .when((s == labels["app"]) & (af == 1), 1)
            .otherwise(0))
