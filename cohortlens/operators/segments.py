"""Activity status, flags, brackets and segment reports.

Membership tests are equi joins against the distinct non-NULL keys of the
other table (no nested-loop join). The report status reproduces SQL's
null-aware ``IN`` / ``NOT IN`` exactly: two scalar subqueries tell whether the
key table is empty and whether it holds a NULL key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.config import (
    DEFAULT, REPORT_LABELS, STATUS_BOTH, STATUS_INACTIVE, TABLE_LABELS, Params,
)
from cohortlens.functions import age_bracket, income_rank, quantile, ratio, round_half_up

_KEY = "User_ID"


def _markers(users: DataFrame, keyed: DataFrame, name: str) -> DataFrame:
    keys = keyed.select(_KEY).where(F.col(_KEY).isNotNull()).distinct().withColumn(name, F.lit(True))
    return users.join(keys, _KEY, "left")


def _key_facts(keyed: DataFrame) -> Column:
    """Scalar subquery: struct(nonempty, has_null) of a key column."""
    return keyed.select(F.struct((F.count(F.lit(1)) > 0).alias("nonempty"),
                                 (F.count_if(F.col(_KEY).isNull()) > 0).alias("has_null"))).scalar()


def _sql_in(key: Column, member: Column, facts: Column) -> Column:
    """Three-valued ``key IN (subquery)`` from a join marker."""
    return (F.when(~facts.getField("nonempty"), F.lit(False))
            .when(key.isNull(), F.lit(None).cast("boolean"))
            .when(member.isNotNull(), F.lit(True))
            .when(facts.getField("has_null"), F.lit(None).cast("boolean"))
            .otherwise(F.lit(False)))


def activity_status(users: DataFrame, services: DataFrame, app_usage: DataFrame,
                    labels: dict = REPORT_LABELS, keep: tuple = ("Region", "IncomeBracket")) -> DataFrame:
    """Report status per user (``NOT IN`` semantics, lower-case labels).
    Membership and key facts become columns first, so each scalar subquery
    occurs once in the plan."""
    u = users.select(_KEY, *keep)
    u = _markers(_markers(u, services, "_in_svc"), app_usage, "_in_app")
    u = u.select("*", _key_facts(services).alias("_f_svc"), _key_facts(app_usage).alias("_f_app"))
    key = F.col(_KEY)
    u = u.select(_KEY, *keep, _sql_in(key, F.col("_in_svc"), F.col("_f_svc")).alias("_svc"),
                 _sql_in(key, F.col("_in_app"), F.col("_f_app")).alias("_app"))
    in_svc, in_app = F.col("_svc"), F.col("_app")
    status = (F.when(~in_app & ~in_svc, STATUS_INACTIVE)
              .when(~in_app & in_svc, labels["services"])
              .when(~in_svc & in_app, labels["app"])
              .otherwise(STATUS_BOTH))
    return u.select(_KEY, *keep, status.alias("UserStatus"))


def status_from_markers(svc_present: Column, app_present: Column, labels: dict = TABLE_LABELS) -> Column:
    """Join-based status of the RFM and churn tables (title-case labels)."""
    return (F.when(svc_present & app_present, STATUS_BOTH)
            .when(svc_present, labels["services"])
            .when(app_present, labels["app"])
            .otherwise(STATUS_INACTIVE))


def activity_flags(status: DataFrame, keep: tuple = ("Region", "IncomeBracket"),
                   labels: dict = REPORT_LABELS) -> DataFrame:
    s = F.col("UserStatus")
    flag = lambda c: F.when(c, 1).otherwise(0)
    return status.select(
        _KEY, *keep,
        F.lit(1).alias("Total_User"),
        flag(s.isin(STATUS_BOTH, labels["services"], labels["app"])).alias("Active_User"),
        flag(s == STATUS_INACTIVE).alias("Inactive_User"),
        flag(s == labels["services"]).alias("No_App_User"),
        flag(s == labels["app"]).alias("App_Only_User"),
        flag(s == STATUS_BOTH).alias("App_And_Services"))


def with_age_bracket(users: DataFrame) -> DataFrame:
    return users.withColumn("Age_Bracket", age_bracket("Age"))


# Report column name per service type.
TYPE_COLUMNS = (
    ("Follow-up Appointment", "Follow_up_Appointments"),
    ("Medication Support", "Medication_Support"),
    ("Preventive Screening", "Preventative_Screenings"),
    ("Subscription Benefit", "Subscription_Benefits"),
    ("Telehealth Consultation", "Telehealth_Consultations"),
    ("Vaccination", "Vaccinations"),
)


def service_mix(services: DataFrame) -> DataFrame:
    """Per user: number of service ids and count of each service type,
    aggregated before any join so users are not fanned out to services."""
    return services.groupBy(_KEY).agg(
        F.count("Service_ID").alias("Service_Count"),
        *[F.count_if(F.col("ServiceType") == t).alias(c) for t, c in TYPE_COLUMNS])


def engagement_core(engagement_totals: DataFrame, medians: DataFrame, customer_churn: DataFrame,
                    mix: DataFrame) -> DataFrame:
    """Per service user: churn risk, campaign engagement, median cadence and
    service mix (all inputs at user grain, aligned on the user partitioning)."""
    return (mix.join(engagement_totals.select(_KEY, "Total_Engagements"), _KEY, "left")
            .join(medians, _KEY, "left")
            .join(customer_churn.select(_KEY, "Churn_Risk"), _KEY, "left")
            .select(_KEY, "Churn_Risk",
                    F.coalesce("Total_Engagements", F.lit(0)).alias("Total_Campaign_Engagements"),
                    "Median_Days_Between_Services", "Service_Count", *[c for _, c in TYPE_COLUMNS]))


def engaged_users(users: DataFrame, services: DataFrame | None, engagement_totals: DataFrame | None,
                  medians: DataFrame | None, customer_churn: DataFrame | None,
                  keep: tuple = ("Region", "IncomeBracket"), mix: DataFrame | None = None,
                  core: DataFrame | None = None) -> DataFrame:
    """Users with at least one service, with their segment keys, churn risk,
    campaign engagement, median cadence and service mix (``mix`` or the whole
    ``engagement_core`` may be passed precomputed)."""
    if core is None:
        mix = service_mix(services) if mix is None else mix
        core = engagement_core(engagement_totals, medians, customer_churn, mix)
    return users.select(_KEY, *keep).join(core, _KEY, "inner").select(
        _KEY, *keep, *[c for c in core.columns if c != _KEY])


_FLAGS = (("Total_User", "Total_Users", None),
          ("Active_User", "Active_Users", "Proportion_of_Active_Users"),
          ("Inactive_User", "Inactive_Users", "Proportion_of_Inactive_Users"),
          ("No_App_User", "No_App_Users", "Proportion_of_No_App_Users"),
          ("App_Only_User", "App_Only_Users", "Proportion_of_App_Only_Users"),
          ("App_And_Services", "App_And_Services", "Proportion_of_App_And_Services_Users"))


def segment_report(flags: DataFrame, engaged: DataFrame, by: list, rename: dict | None = None,
                   status_shares: bool = False, params: Params = DEFAULT) -> DataFrame:
    """Per segment: user counts by status, average engagement and services,
    median of per-user median cadence, churn proportion (service-user churners
    over all active users) and service-type shares. ``engaged`` may be the
    per-user core without segment keys: the left join from the flags (one row
    per user of the users table) supplies the keys and drops unknown users."""
    rename = rename or {}
    eng = engaged.drop(*[c for c in by if c in engaged.columns])
    aggs = []
    for src, out, share in _FLAGS:
        aggs.append(F.sum(src).alias(out))
        if status_shares and share:
            aggs.append(round_half_up(ratio(F.sum(src), F.sum("Total_User")), 4).alias(share))
    aggs += [
        round_half_up(F.avg("Total_Campaign_Engagements"), 2).alias("Avg_Campaign_Engagements"),
        quantile("Median_Days_Between_Services", params.cadence_quantile, params.exact_quantiles,
                 params.approx_accuracy).cast("int").alias("Median_Days_Between_Services"),
        round_half_up(F.avg("Service_Count"), 2).alias("Avg_Services_Engaged"),
        round_half_up(ratio(F.sum("Churn_Risk"), F.sum("Active_User")), 4).alias("Proportion_of_Churn_Risk"),
    ]
    aggs += [round_half_up(ratio(F.sum(c), F.sum("Service_Count")), 4).alias(f"Proportion_of_{c}")
             for _, c in TYPE_COLUMNS]
    out = flags.join(eng, _KEY, "left").groupBy(*by).agg(*aggs)
    for old, new in rename.items():
        out = out.withColumnRenamed(old, new)
    return out


def order_region_report(report: DataFrame) -> DataFrame:
    return report.orderBy(F.col("Region").asc_nulls_first(), income_rank("Income_Bracket").asc_nulls_first())
