"""Named queries over the driver's TESTDATA tables.

Each entry takes ``(spark, sf_dir)``, derives the five base tables from the
Parquet files (``sources.testdata``) and returns the operator's DataFrame.
Array-valued history columns are rendered as ``type@date;...`` text so the
result can be compared with the SQL oracle value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.config import TESTDATA as P
from cohortlens.operators import attribution as attr
from cohortlens.operators import bitmaps, churn, scoring, segments, sequence
from cohortlens.plans import reports
from cohortlens.scope import Scope
from cohortlens.sources import testdata

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


#: Owns the intermediates of the query built last: a query releases those of
#: the one before it.
kept = Scope()


def register(name: str):
    def deco(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            kept.release()
            kept.open()
            try:
                return fn(spark, sf_dir)
            finally:
                kept.close()

        _REGISTRY[name] = run
        return fn
    return deco


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _t(spark, sf_dir):
    return testdata.load(spark, sf_dir)


# ---------------------------------------------------------------- quality
for _key, _table in (("users", "users"), ("services", "services"), ("campaigns", "campaigns"),
                     ("app", "app_usage"), ("responses", "responses")):
    register(f"null_profile_{_key}")(lambda s, d, _table=_table: reports.null_profile(_t(s, d), _table))


@register("key_uniqueness_users")
def _ku_users(spark, sf_dir):
    return reports.key_check(_t(spark, sf_dir), "users")


@register("key_uniqueness_services")
def _ku_services(spark, sf_dir):
    return reports.key_check(_t(spark, sf_dir), "services")



@register("key_uniqueness_bitmaps")
def _ku_bitmaps(spark, sf_dir):
    t = _t(spark, sf_dir)
    checks = [bitmaps.distinct_keys(getattr(t, name), key, "All_Keys", "Distinct_Keys").select(F.lit(name).alias("Table_Name"), "*")
              for name, (key, _, _) in reports.KEY_CHECKS.items()]
    return checks[0].unionByName(checks[1])

# ---------------------------------------------------------------- segment-report family


def _rparts(spark, sf_dir, keep=("Region", "IncomeBracket")):
    return reports.report_parts(_t(spark, sf_dir), keep, P)


@register("service_cadence")
def _cadence(spark, sf_dir):
    return sequence.service_cadence(_t(spark, sf_dir).services)


@register("cadence_median")
def _cadence_median(spark, sf_dir):
    return _rparts(spark, sf_dir)["medians"]


@register("churn_criteria")
def _criteria(spark, sf_dir):
    return _rparts(spark, sf_dir)["criteria"]


@register("churn_by_customer")
def _by_customer(spark, sf_dir):
    return _rparts(spark, sf_dir)["by_customer"]


@register("activity_status")
def _status(spark, sf_dir):
    t = _t(spark, sf_dir)
    return segments.activity_status(t.users, t.services, t.app_usage)


@register("activity_flags")
def _flags(spark, sf_dir):
    t = _t(spark, sf_dir)
    return segments.activity_flags(segments.activity_status(t.users, t.services, t.app_usage))


@register("age_bracket")
def _age_bracket(spark, sf_dir):
    return segments.with_age_bracket(_t(spark, sf_dir).users).select("User_ID", "Age", "Age_Bracket")


@register("engaged_users")
def _engaged(spark, sf_dir):
    p = _rparts(spark, sf_dir)
    return segments.engaged_users(p["users"], None, None, None, None, core=p["core"])


@register("region_report")
def _region_report(spark, sf_dir):
    return reports.region_report(_t(spark, sf_dir), P)


@register("age_report")
def _age_report(spark, sf_dir):
    return reports.age_report(_t(spark, sf_dir), P)


@register("app_adoption_by_age")
def _adoption(spark, sf_dir):
    return reports.app_adoption_by_age(_t(spark, sf_dir))

# ---------------------------------------------------------------- churn model


def _cparts(spark, sf_dir):
    return reports.churn_parts(_t(spark, sf_dir), P)


@register("service_sequence")
def _sequence(spark, sf_dir):
    # The columns of the sequence
    seq = sequence.service_sequence(_t(spark, sf_dir).services)
    return seq.select("User_ID", "ServiceStartDate", "ServiceEndDate", "ServiceType", "AccessChannel",
                      F.col("Service_Fee_Sum").cast("double").alias("Service_Fee_Sum"), "Services", "First_Service",
                      "First_Service_Type", "First_Access_Channel", "Second_Service_Type", "Next_Service_Type",
                      "Next_Service_Start_Date", "Days_Since_Last_Service", "Service_Quantity")


@register("gap_cutoffs")
def _cutoffs(spark, sf_dir):
    return churn.gap_cutoffs(sequence.service_sequence(_t(spark, sf_dir).services), P)


@register("service_churn")
def _service_churn(spark, sf_dir):
    return _cparts(spark, sf_dir)["service_churn"]


@register("app_churn")
def _app_churn(spark, sf_dir):
    return churn.app_churn(_t(spark, sf_dir).app_usage, P)


@register("campaign_totals")
def _campaign_totals(spark, sf_dir):
    return churn.campaign_totals(_t(spark, sf_dir).responses)


@register("service_summary")
def _summary(spark, sf_dir):
    return sequence.service_summary(sequence.service_sequence(_t(spark, sf_dir).services), P).withColumn("All_Service_Types", reports.history_text())


@register("service_history")
def _history(spark, sf_dir):
    return sequence.history_rows(sequence.service_sequence(_t(spark, sf_dir).services))


#: Services in a row of the chunked history here: small, so that users of the
#: test tables have several rows.
CHUNK = 5


@register("service_history_chunks")
def _history_chunks(spark, sf_dir):
    seq = sequence.service_sequence(_t(spark, sf_dir).services)
    return sequence.history_chunks(seq, P.with_(history_chunk=CHUNK)).withColumn(
        "Service_Types", reports.history_text("Service_Types"))


def churn_table(spark, sf_dir, history: bool = False):
    """The churn table; the history array only where it is part of the result."""
    t = _t(spark, sf_dir)
    return reports.churn_table(t, P, reports.churn_parts(t, P, history=history))


@register("churn_table")
def _churn_table(spark, sf_dir):
    return churn_table(spark, sf_dir, history=True).withColumn("All_Service_Types", reports.history_text())


@register("status_share")
def _status_share(spark, sf_dir):
    return reports.status_share(churn_table(spark, sf_dir))


@register("status_profile")
def _status_profile(spark, sf_dir):
    return reports.status_profile(churn_table(spark, sf_dir), P)


@register("at_risk_cohorts")
def _at_risk(spark, sf_dir):
    t = _t(spark, sf_dir)
    return reports.at_risk_cohorts(t, churn_table(spark, sf_dir))


@register("churn_truth_table")
def _truth(spark, sf_dir):
    return reports.churn_truth_table(churn_table(spark, sf_dir))


@register("service_churn_per_user")
def _per_user(spark, sf_dir):
    return churn.service_churn_per_user(sequence.service_sequence(_t(spark, sf_dir).services), P)


@register("journey_transitions")
def _transitions(spark, sf_dir):
    return sequence.journey_transitions(sequence.service_sequence(_t(spark, sf_dir).services))


@register("journey_dropoff")
def _dropoff(spark, sf_dir):
    return sequence.journey_dropoff(sequence.service_sequence(_t(spark, sf_dir).services))

# ---------------------------------------------------------------- RFM


@register("rfm_service")
def _rfm_service(spark, sf_dir):
    return scoring.rfm_service(_t(spark, sf_dir).services, P)


@register("rfm_app")
def _rfm_app(spark, sf_dir):
    return scoring.rfm_app(_t(spark, sf_dir).app_usage, P)


@register("rfm_table")
def _rfm_table(spark, sf_dir):
    return reports.rfm_table(_t(spark, sf_dir), P)


@register("rfm_distribution")
def _rfm_distribution(spark, sf_dir):
    p = reports.rfm_parts(_t(spark, sf_dir), P)
    return scoring.rfm_distribution(p["service"], p["app"])

# ---------------------------------------------------------------- attribution


@register("attribution_base")
def _attr_base(spark, sf_dir):
    t = _t(spark, sf_dir)
    return attr.attribution_base(t.campaigns, t.responses, t.services, P)


@register("attribution")
def _attribution(spark, sf_dir):
    return reports.attribution_table(_t(spark, sf_dir), P)


@register("conversions_by_type")
def _conv_type(spark, sf_dir):
    return attr.conversions_by_type(reports.attribution_table(_t(spark, sf_dir), P))


@register("conversion_rate")
def _conv_rate(spark, sf_dir):
    return attr.conversion_rate(reports.attribution_table(_t(spark, sf_dir), P))


@register("conversion_crosstab")
def _crosstab(spark, sf_dir):
    return attr.conversion_crosstab(reports.attribution_table(_t(spark, sf_dir), P))
