"""Per-user service sequences: cadence, merged sequence, user summary and
journey analytics.

All per-user orderings break ties on start date with a unique service key
(``Service_ID``, or the smallest ``Service_ID`` of a merged group), so results
are repeatable. Every window of one function shares a single spec, so Spark
plans one sort and one exchange for all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.config import DEFAULT, Params
from cohortlens.functions import days_between, first_in_order, money_sum, quantile, ratio, round_half_up
from cohortlens.operators.ordered import group_window, hot_keys

_ORDER = ("ServiceStartDate", "Seq_ID")


def service_cadence(services: DataFrame, hot: list | None = None, carry: tuple = ()) -> DataFrame:
    """One row per service record: days since the user's previous service and
    the service's ordinal (raw records, no merging). Users with very many
    records are split over several tasks (``ordered.group_window``). ``carry``
    passes further service columns through (for consumers of the same rows)."""
    g = group_window(services.select("User_ID", "Service_ID", "ServiceStartDate", *carry), "User_ID",
                     ["ServiceStartDate", "Service_ID"], lag=["ServiceStartDate"],
                     hot=hot_keys(services, "User_ID") if hot is None else hot)
    return g.select(
        "User_ID", "Service_ID", "ServiceStartDate",
        days_between("ServiceStartDate", "_prev_ServiceStartDate").alias("Days_Since_Last_Service"),
        F.col("_rn").alias("Service_Quantity"), *carry)


def cadence_median(cadence: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Median gap per user over the cadence rows; NULL for one-service users."""
    return cadence.groupBy("User_ID").agg(
        quantile("Days_Since_Last_Service", params.cadence_quantile, params.exact_quantiles,
                 params.approx_accuracy).cast("int").alias("Median_Days_Between_Services"))


_MERGE_KEYS = ("User_ID", "ServiceStartDate", "ServiceEndDate", "ServiceType", "AccessChannel")


def merged_services(services: DataFrame, copartition: bool = True, spread: bool = False) -> DataFrame:
    """Identical (user, start, end, type, channel) records merge into one row
    with summed fee and counted types. With ``copartition`` the input is
    hash-partitioned by user first, so the grouping and the following
    per-user window share one shuffle; without it (hot users present, or
    services bucketed by user) the grouping uses the partitioning it finds, or
    shuffles on all five keys and combines partially first. ``spread`` deals
    the rows by all five keys whatever the input's partitioning."""
    src = services.repartition("User_ID") if copartition else services
    src = services.repartition(*_MERGE_KEYS) if spread else src
    return (src.groupBy(*_MERGE_KEYS)
            .agg(money_sum("ServiceFee").alias("Service_Fee_Sum"),
                 F.count("ServiceType").alias("Services"),
                 F.min("ServiceStartDate").alias("First_Service"),
                 F.min("Service_ID").alias("Seq_ID")))


def service_sequence(services: DataFrame, hot: list | None = None, bucketed: bool = False) -> DataFrame:
    """Merged services with their per-user sequence attributes: first type and
    channel, second type, next type and date, gap to the previous service,
    ordinal and a last-service marker. ``bucketed`` services (stored by user)
    are not shuffled, unless a hot user would keep one bucket's task busy."""
    hot = hot_keys(services, "User_ID") if hot is None else hot
    m = merged_services(services, copartition=not (hot or bucketed), spread=bool(hot) and bucketed)
    g = group_window(m, "User_ID", list(_ORDER), lag=["ServiceStartDate"],
                     lead=["ServiceType", "ServiceStartDate"], first=["ServiceType", "AccessChannel"],
                     second=["ServiceType"], hot=hot)
    return g.select(
        *m.columns,
        F.col("_first_ServiceType").alias("First_Service_Type"),
        F.col("_first_AccessChannel").alias("First_Access_Channel"),
        F.col("_second_ServiceType").alias("Second_Service_Type"),
        F.col("_next_ServiceType").alias("Next_Service_Type"),
        F.col("_next_ServiceStartDate").alias("Next_Service_Start_Date"),
        days_between("ServiceStartDate", "_prev_ServiceStartDate").alias("Days_Since_Last_Service"),
        F.col("_rn").alias("Service_Quantity"),
        F.col("_is_last").alias("Is_Last"),
    )


# The fields of one service of a history.
_SERVICE = "struct<ServiceType:string,ServiceStartDate:date>"


def history_chunks(seq: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The ordered history in rows of bounded length: ``User_ID, Chunk`` (from
    0), ``First_Position``, ``Services`` (number) and ``Service_Types``, the
    services at these positions in order.  The sequence's own ordinal says
    which chunk a service belongs to, so a user with many services is dealt
    over many groups and no array exceeds ``params.history_chunk``."""
    size = params.history_chunk
    position = F.col("Service_Quantity")
    chunk = F.floor((position - 1) / size)
    items = F.array_sort(F.collect_list(F.struct(position.alias("p"), F.col("ServiceType").alias("t"),
                                                 F.col("ServiceStartDate").alias("s"))))
    return seq.groupBy("User_ID", chunk.alias("Chunk")).agg(
        F.min(position).alias("First_Position"), F.count(F.lit(1)).alias("Services"),
        F.transform(items, lambda x: F.struct(x["t"].alias("ServiceType"), x["s"].alias("ServiceStartDate")))
        .cast(f"array<{_SERVICE}>").alias("Service_Types"))


def history_arrays(seq: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """``User_ID, All_Service_Types``: the chunks of each user put together in
    one row.  A user with more than ``params.history_limit`` services makes the
    query fail with an error that names the user; services beyond the limit are
    not gathered before that."""
    chunks = history_chunks(seq, params)
    last = F.max(F.col("First_Position") + F.col("Services") - 1)
    parts = F.array_sort(F.collect_list(F.when(F.col("First_Position") <= params.history_limit,
                                               F.struct("Chunk", "Service_Types"))))
    too_long = F.raise_error(F.concat(
        F.lit("user "), F.coalesce(F.col("User_ID").cast("string"), F.lit("NULL")), F.lit(" has "), F.col("_last").cast("string"),
        F.lit(f" services, more than history_limit={params.history_limit}; read history_chunks instead")))
    whole = chunks.groupBy("User_ID").agg(last.alias("_last"), parts.alias("_parts"))
    return whole.select("User_ID", F.when(F.col("_last") > params.history_limit, too_long.cast(f"array<{_SERVICE}>")).otherwise(
        F.flatten(F.transform("_parts", lambda x: x["Service_Types"]))).alias("All_Service_Types"))


def service_summary(seq: DataFrame, params: Params = DEFAULT, history: bool = True) -> DataFrame:
    """One row per user: totals, first/last dates, first/second type, median
    gap, ordered history and what follows the first pivot-type service.
    ``history`` adds the array of all services from ``history_arrays``, which
    fails for a user above ``params.history_limit``; without it no row grows
    with a user's history."""
    pivot = F.col("ServiceType") == params.pivot_service
    summary = seq.groupBy("User_ID").agg(
        F.sum("Service_Fee_Sum").cast("double").alias("Total_Service_Fee"),
        F.sum("Services").alias("Total_Number_of_Services"),
        F.min("First_Service").alias("First_Service_Date"),
        F.max("ServiceStartDate").alias("Last_Service_Start_Date"),
        F.max("ServiceEndDate").alias("Last_Service_End_Date"),
        F.max("First_Service_Type").alias("First_Service_Type"),
        F.max("Second_Service_Type").alias("Second_Service_Type"),
        F.max("First_Access_Channel").alias("First_Access_Channel"),
        quantile("Days_Since_Last_Service", params.cadence_quantile, params.exact_quantiles,
                 params.approx_accuracy).cast("int").alias("Median_Days_Between_Services"),
        first_in_order("Next_Service_Type", *_ORDER, where=pivot).alias("Post_Telehealth_Service"),
        first_in_order(days_between("Next_Service_Start_Date", "ServiceStartDate"), *_ORDER,
                       where=pivot).alias("Days_After_Telehealth"),
    )
    if not history:
        return summary
    after = summary.columns.index("Post_Telehealth_Service")
    arrays = history_arrays(seq, params)
    # both sides are dealt by User_ID; services without a user, if any, are one
    # row that an equi join does not meet
    nobody = arrays.where(F.col("User_ID").isNull()).select("All_Service_Types").scalar()
    both = summary.join(arrays, "User_ID", "left").withColumn(
        "All_Service_Types", F.when(F.col("User_ID").isNull(), nobody).otherwise(F.col("All_Service_Types")))
    return both.select(*summary.columns[:after], "All_Service_Types", *summary.columns[after:])


def history_rows(seq: DataFrame) -> DataFrame:
    """The ordered history as rows (user, position, type, date), from the
    sequence's own ordinal: no user's history meets in one row."""
    return seq.select("User_ID", F.col("Service_Quantity").alias("Position"), "ServiceType", "ServiceStartDate")


def journey_transitions(seq: DataFrame) -> DataFrame:
    """Counts of (service type -> next service type) steps and the median days
    between them."""
    steps = seq.where(F.col("Next_Service_Start_Date").isNotNull()).select(
        F.col("ServiceType").alias("From_Type"), F.col("Next_Service_Type").alias("To_Type"),
        days_between("Next_Service_Start_Date", "ServiceStartDate").alias("Days_To_Next"))
    return steps.groupBy("From_Type", "To_Type").agg(
        F.count(F.lit(1)).alias("Transitions"),
        quantile("Days_To_Next", 0.5).cast("int").alias("Median_Days_To_Next"))


def journey_dropoff(seq: DataFrame) -> DataFrame:
    """Users reaching their n-th service, how many go on to an (n+1)-th and
    the share continuing."""
    reached = seq.groupBy("Service_Quantity").agg(
        F.count(F.lit(1)).alias("Users_Reaching"),
        F.count_if(~F.col("Is_Last")).alias("Users_Continuing"))
    return reached.select(
        F.col("Service_Quantity").alias("Service_Number"), "Users_Reaching", "Users_Continuing",
        round_half_up(ratio("Users_Continuing", "Users_Reaching"), 4).alias("Continue_Rate"))
