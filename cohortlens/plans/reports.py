"""The six analyses of the reference, composed from operators.

Intermediates read by several consumers (the service sequence, the cadence
rows) are persisted once instead of being recomputed per consumer: Catalyst
does not share a common sub-plan whose consumers prune different columns.  The
open ``scope.Scope`` owns them; ``write_analyses`` runs all six in such scopes.
"""

from __future__ import annotations

from contextvars import copy_context

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.config import DEFAULT, REPORT_LABELS, TABLE_LABELS, Params
from cohortlens.functions import ratio, round_half_up
from cohortlens.operators import attribution as attr_ops
from cohortlens.operators import churn, quality, scoring, segments, selection, sequence
from cohortlens.scope import Scope
from cohortlens.scope import keep as keep_frame
from cohortlens.sources import schemas, sinks
from cohortlens.sources.tables import Tables


# ---------------------------------------------------------------- quality


def check_contracts(t: Tables) -> None:
    """Fail loudly when a key the analyses join on at user grain repeats:
    users and app usage must hold one row per User_ID (a repeat would fan out
    the RFM and churn tables), services one row per Service_ID. One
    aggregation job per table; run it once per load, not per query."""
    quality.assert_unique(t.users, "User_ID")
    quality.assert_unique(t.app_usage, "User_ID")
    quality.assert_unique(t.services.where(F.col("Service_ID").isNotNull()), "Service_ID")
    quality.assert_unique(t.campaigns, "Campaign_ID")


def null_profile(t: Tables, table: str) -> DataFrame:
    """Rows and NULLs of one base table; no other table is opened."""
    return quality.null_profile(getattr(t, table))


def null_profiles(t: Tables) -> dict[str, DataFrame]:
    return {name: null_profile(t, name) for name in schemas.BY_NAME}


# The key and the two result columns of each check.
KEY_CHECKS = {"users": ("User_ID", "All_Users", "Distinct_Users"),
              "services": ("Service_ID", "All_Service_IDs", "Distinct_Service_IDs")}


def key_check(t: Tables, table: str) -> DataFrame:
    """Rows and distinct keys of one base table; no other table is opened."""
    return quality.key_uniqueness(getattr(t, table), *KEY_CHECKS[table])


def key_checks(t: Tables) -> dict[str, DataFrame]:
    return {table: key_check(t, table) for table in KEY_CHECKS}

# ---------------------------------------------------------------- churn model


def churn_parts(t: Tables, params: Params = DEFAULT, persist: bool = True, history: bool = True) -> dict[str, DataFrame]:
    seq = sequence.service_sequence(t.services, bucketed=t.bucketed)
    if persist:
        seq = keep_frame(seq, params.storage())
    cut = churn.gap_cutoffs(seq, params)
    return {
        "sequence": seq,
        "cutoffs": cut,
        "service_churn": churn.service_churn(seq, cut, params),
        "app_churn": churn.app_churn(t.app_usage, params),
        "campaign_totals": churn.campaign_totals(t.responses),
        "service_summary": sequence.service_summary(seq, params, history),
        "app_summary": churn.app_summary(t.app_usage, params),
    }


# The columns of the churn table, in order.
CHURN_COLUMNS = [
    "User_ID", "Final_Churn_Flag", "UserStatus", "Service_Churn_Flag", "Service_Churn_Level",
    "Days_Since_App_Activity", "App_Churn_Flag", "App_Churn_Level", "Campaign_Responses",
    "Campaign_Engagements", "Total_Service_Fee", "Total_Number_of_Services", "First_Service_Date",
    "Last_Service_Start_Date", "Last_Service_End_Date", "First_Service_Type", "Second_Service_Type",
    "First_Access_Channel", "Median_Days_Between_Services", "All_Service_Types", "Post_Telehealth_Service",
    "Days_After_Telehealth", "AvgSessionMinutes", "SpendingSegment", "TelehealthSpend",
    "FirstPurchaseDaysAfterInstall", "PaymentMethod", "LastServiceDate",
]


def churn_table(t: Tables, params: Params = DEFAULT, parts: dict | None = None) -> DataFrame:
    """One row per user row: final churn flag, status, service and app churn,
    campaign totals, service summary and app attributes. All inputs are at
    user grain, so the left joins never fan out. App churn is derived from the
    one app-summary join instead of a second pass over the app data."""
    p = parts or churn_parts(t, params)
    ss = p["service_summary"].withColumn("_ss", F.lit(True))
    app = p["app_summary"].withColumn("_app", F.lit(True))
    j = (t.users.select("User_ID")
         .join(p["campaign_totals"], "User_ID", "left")
         .join(p["service_churn"], "User_ID", "left")
         .join(ss, "User_ID", "left")
         .join(app, "User_ID", "left"))
    has_app = F.col("_app").isNotNull()
    j = j.select("*", *[F.when(has_app, e).alias(n) for n, e in churn.app_churn_columns(params=params).items()])
    j = j.withColumn("UserStatus", segments.status_from_markers(F.col("_ss").isNotNull(), has_app, TABLE_LABELS))
    j = j.withColumn("Final_Churn_Flag", churn.final_churn_flag())
    return j.select(*[c for c in CHURN_COLUMNS if c in j.columns])


def history_text(col: str = "All_Service_Types"):
    """Text form of the ordered history, ``type@date;...``, for comparisons."""
    return F.array_join(F.transform(F.col(col), lambda x: F.concat(
        x["ServiceType"], F.lit("@"), x["ServiceStartDate"].cast("string"))), ";")


def status_share(churn_tbl: DataFrame) -> DataFrame:
    """Users and share per status. The total is a window over the (at most
    four) grouped rows, so the churn table is computed once."""
    g = churn_tbl.groupBy("UserStatus").agg(F.count(F.lit(1)).alias("Users"))
    total = F.sum("Users").over(Window.partitionBy(F.lit(0)))
    return g.select("UserStatus", "Users", round_half_up(ratio(F.col("Users"), total), 4).alias("Share"))


def status_profile(churn_tbl: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per status: mean of per-user median cadence, median fee and mean app
    recency (users without the measure are skipped)."""
    facts = keep_frame(churn_tbl.select("UserStatus", "Median_Days_Between_Services", "Total_Service_Fee",
                                  "Days_Since_App_Activity"), params.storage())
    means = facts.groupBy("UserStatus").agg(
        F.count(F.lit(1)).alias("Users"),
        round_half_up(F.avg("Median_Days_Between_Services"), 2).alias("Avg_Days_Between_Services"),
        round_half_up(F.avg("Days_Since_App_Activity"), 2).alias("Avg_Days_Since_App_Activity"))
    fees = selection.group_median(facts, "UserStatus", "Total_Service_Fee", "Median_Service_Fee")
    return means.join(F.broadcast(fees), "UserStatus", "left")  # a row per status


def at_risk_cohorts(t: Tables, churn_tbl: DataFrame) -> DataFrame:
    u = t.users.select("User_ID", "Region", "IncomeBracket")
    return u.join(churn_tbl.select("User_ID", "Final_Churn_Flag"), "User_ID", "left").groupBy(
        "Region", "IncomeBracket").agg(
        F.count(F.lit(1)).alias("Users"),
        F.sum("Final_Churn_Flag").alias("At_Risk_Users"),
        round_half_up(ratio(F.sum("Final_Churn_Flag"), F.count(F.lit(1))), 4).alias("At_Risk_Share"))


def churn_truth_table(churn_tbl: DataFrame) -> DataFrame:
    return churn_tbl.groupBy("UserStatus", "Service_Churn_Flag", "App_Churn_Flag", "Final_Churn_Flag").agg(
        F.count(F.lit(1)).alias("Users"))

# ---------------------------------------------------------------- segment reports


def report_parts(t: Tables, keep: tuple, params: Params = DEFAULT, persist: bool = True) -> dict:
    """Intermediates of the segment reports. The cadence rows and the per-user
    service mix are each computed once (the mix from the cadence rows) and
    read by several consumers: the mix gives the service-user markers, the key
    facts of the NOT IN tests, the service counts and the per-user totals of
    the churn rule."""
    # one pass over services: the cadence rows carry the type, and the per-user
    # mix is aggregated from them (already partitioned by user)
    cad = sequence.service_cadence(t.services, carry=("ServiceType",))
    if persist:
        cad = keep_frame(cad, params.storage())
    mix = segments.service_mix(cad)
    if persist:
        mix = keep_frame(mix, params.storage())
    cut = churn.gap_cutoffs(cad, params)
    crit = churn.churn_criteria(cad, cut, params)
    totals = mix.select("User_ID", F.col("Service_Count").alias("Total_Services"))
    by_customer = churn.churn_by_customer(None, crit, totals=totals)
    medians = sequence.cadence_median(cad, params)
    eng_totals = t.responses.groupBy("User_ID").agg(F.sum("EngagementCount").alias("Total_Engagements"))
    users = segments.with_age_bracket(t.users) if "Age_Bracket" in keep else t.users
    status = segments.activity_status(users, mix, t.app_usage, REPORT_LABELS, keep)
    flags = segments.activity_flags(status, keep)
    core = segments.engagement_core(eng_totals, medians, by_customer, mix)
    return {"core": core, "cadence": cad, "cutoffs": cut, "criteria": crit, "by_customer": by_customer,
            "medians": medians, "totals": eng_totals, "status": status, "flags": flags, "mix": mix,
            "users": users}


def region_report(t: Tables, params: Params = DEFAULT, ordered: bool = True) -> DataFrame:
    p = report_parts(t, ("Region", "IncomeBracket"), params)
    rep = segments.segment_report(p["flags"], p["core"], ["Region", "IncomeBracket"],
                                  {"IncomeBracket": "Income_Bracket"}, params=params)
    return segments.order_region_report(rep) if ordered else rep


def age_report(t: Tables, params: Params = DEFAULT, ordered: bool = True) -> DataFrame:
    p = report_parts(t, ("Age_Bracket",), params)
    rep = segments.segment_report(p["flags"], p["core"], ["Age_Bracket"], status_shares=True, params=params)
    return rep.orderBy(F.col("Age_Bracket").asc_nulls_first()) if ordered else rep


def segment_reports(t: Tables, params: Params = DEFAULT) -> dict[str, DataFrame]:
    """Both segment reports from one set of intermediates: the cadence rows,
    service mix, cutoffs, medians and churn rule are built (and cached) once,
    only the user segment keys differ."""
    base = report_parts(t, ("Region", "IncomeBracket"), params)
    aged = segments.with_age_bracket(t.users)
    status = segments.activity_status(aged, base["mix"], t.app_usage, REPORT_LABELS, ("Age_Bracket",))
    flags = segments.activity_flags(status, ("Age_Bracket",))
    region = segments.segment_report(base["flags"], base["core"], ["Region", "IncomeBracket"],
                                     {"IncomeBracket": "Income_Bracket"}, params=params)
    age = segments.segment_report(flags, base["core"], ["Age_Bracket"], status_shares=True, params=params)
    return {"region": segments.order_region_report(region),
            "age": age.orderBy(F.col("Age_Bracket").asc_nulls_first())}


def app_adoption_by_age(t: Tables) -> DataFrame:
    """Share of users with an app-usage row per age bracket."""
    u = segments.with_age_bracket(t.users).select("User_ID", "Age_Bracket")
    app_keys = t.app_usage.select("User_ID").where(F.col("User_ID").isNotNull()).distinct() \
        .withColumn("_app", F.lit(1))
    j = u.join(app_keys, "User_ID", "left")
    return j.groupBy("Age_Bracket").agg(
        F.count(F.lit(1)).alias("Users"), F.count("_app").alias("App_Users"),
        round_half_up(ratio(F.count("_app"), F.count(F.lit(1))), 4).alias("App_Adoption"))

# ---------------------------------------------------------------- RFM


def rfm_parts(t: Tables, params: Params = DEFAULT, **ntile_kw) -> dict:
    """Both RFM models. Their n-tiles run a few small preparatory jobs each
    (count, sample, range sizes); the two models are independent, so their
    jobs are submitted from two driver threads, which keep the caller's job
    group and pool, and overlap.  Fails when app usage repeats a user."""
    quality.assert_unique(t.app_usage, "User_ID")
    out: dict = {}

    def run(name, model, table):
        try:
            out[name] = model(table, params, **ntile_kw)
        except Exception as error:  # raised again by the caller's thread
            out[name] = error

    # a thread has a context of its own; the open scope is part of the caller's
    threads = [InheritableThread(target=copy_context().run, args=(run, *args)) for args in (
        ("service", scoring.rfm_service, t.services), ("app", scoring.rfm_app, t.app_usage))]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    for result in out.values():
        if isinstance(result, Exception):
            raise result
    return out


def rfm_table(t: Tables, params: Params = DEFAULT, ordered: bool = False, **ntile_kw) -> DataFrame:
    p = rfm_parts(t, params, **ntile_kw)
    out = scoring.rfm_table(t.users, p["service"], p["app"])
    return out.orderBy("User_ID") if ordered else out

# ---------------------------------------------------------------- attribution


def attribution_table(t: Tables, params: Params = DEFAULT) -> DataFrame:
    return attr_ops.attribution(t.campaigns, t.responses, t.services, params)

# ---------------------------------------------------------------- all of them


def write_analyses(t: Tables, path: str, params: Params = DEFAULT, history: bool = False) -> list[str]:
    """Writes the tables of all six analyses under ``path`` and returns their
    names.  Each analysis has a scope of its own: what its tables share is
    computed once and released after its last table.  ``history`` adds the
    one-row history to the churn tables (see ``Params.history_limit``); the
    chunked one is always written."""
    def quality_checks():
        return {**{f"null_profile_{n}": null_profile(t, n) for n in schemas.BY_NAME},
                **{f"key_check_{n}": key_check(t, n) for n in KEY_CHECKS}}

    def churn_model():
        parts = churn_parts(t, params, history=history)
        names = ("sequence", "cutoffs", "service_churn", "app_churn", "campaign_totals", "service_summary")
        return {**{n: parts[n] for n in names}, "service_history_chunks": sequence.history_chunks(parts["sequence"], params),
                "churn_table": churn_table(t, params, parts)}

    def rfm():
        parts = rfm_parts(t, params)
        return {"rfm_service": parts["service"], "rfm_app": parts["app"],
                "rfm_table": scoring.rfm_table(t.users, parts["service"], parts["app"])}

    def segment():
        return {f"{n}_report": df for n, df in segment_reports(t, params).items()}

    names = []
    for analysis in (quality_checks, segment, rfm, churn_model, lambda: {"attribution": attribution_table(t, params)}):
        with Scope():
            for name, df in analysis().items():
                sinks.create_table_as(df, f"{path}/{name}")
                names.append(name)
    return names
