"""Outreach attribution.

Reference semantics: every (campaign, responding user) pair is left-joined to
the user's services that start 0..``window`` days after the outreach date
(both ends included). Of each pair's rows only the earliest service is kept
(``Campaign_Service_Rank = 1``), and it is kept only if that service's
earliest campaign is this campaign (``User_Service_Rank = 1``): the two ranks
are computed before filtering, so a pair whose earliest service belongs to an
earlier campaign vanishes instead of becoming "not converted". Pairs without
any service in the window stay with ``Converted = 0``. Ties: service start
then ``Service_ID``; outreach date then ``Campaign_ID``.

Execution of the attribution table: one sweep.

* touches (campaign, user, outreach date) and services lie in one union, dealt
  by (user, range of days) and sorted once by falling day.  The first service
  at or after a touch is then a running minimum, and the touch before it the
  next touch in that order: the service is credited to the touch unless the
  touch before it also lies within the window.  Every source is read once and
  no pair of rows is formed;
* services are reduced to the first per user and day before (map-side
  combined), so a range of days holds a bounded number of them whatever a
  user's history, and a user's touches are bounded by the campaigns of the
  range.  Services of the first ``window`` days of a range also go to the range
  before, touches of its last ``window`` days to the one after;
* of a campaign that occurs more than once, dates that repeat are merged
  before the join and a pair's rows after the sweep, in steps that are planned
  only where the campaigns hold a repeat.

``attribution_base`` keeps every joined row, as that is its output: an equi
join on (user, bin of ``window + 1`` days), each service offered to its own bin
and the one before.  ``touch_matches`` answers the sweep's question by such a
join of days; the tests hold one against the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.config import DEFAULT, Params
from cohortlens.functions import days_between, quantile, ratio, round_half_up
from cohortlens.operators.ordered import group_window, hot_keys
from cohortlens.scope import keep

PAIR = ["Campaign_ID", "User_ID"]
CAMPAIGN_COLS = ["Campaign_ID", "OutreachType", "OutreachDate", "OutreachBudget", "TargetSegment"]
RESPONSE_COLS = ["ResponseFlag", "CTR", "EngagementCount"]
SERVICE_COLS = ["Service_ID", "ServiceStartDate", "ServiceFee", "ServiceType", "AccessChannel"]
OUTPUT = CAMPAIGN_COLS + ["User_ID"] + RESPONSE_COLS + SERVICE_COLS + ["Converted"]


def _bin(date: Column, width: int) -> Column:
    return F.floor(F.unix_date(date) / F.lit(width))


def campaign_pairs(campaigns: DataFrame, responses: DataFrame, carry: list = ()) -> DataFrame:
    """One row per (campaign, user) response joined to its campaign; pairs of
    unknown campaigns drop out (inner join). Duplicate responses of a pair
    collapse to one row (the reference keeps one row per pair)."""
    # one whole response row per pair: every column is taken at the smallest
    # hash of the row's values; a fixed-width key keeps this a partial hash
    # aggregation (a struct minimum would sort the whole response table)
    h = F.xxhash64(*RESPONSE_COLS)
    r = responses.groupBy(*PAIR).agg(*[F.min_by(c, h).alias(c) for c in RESPONSE_COLS])
    return campaigns.select(*CAMPAIGN_COLS, *carry).join(r, "Campaign_ID", "inner")


def window_matches(pairs: DataFrame, services: DataFrame, params: Params = DEFAULT,
                   campaigns: DataFrame | None = None) -> DataFrame:
    """(campaign, user, outreach date) x services in the outreach window.

    Equi join on (user, bin) with bins of ``window + 1`` days: a pair sits in
    the bin of its outreach date, and a service starting on day s can only
    match outreach dates in [s - window, s], which lie in bin(s) - 1 or
    bin(s). Only the services side (the smaller one) is doubled, and every
    match is found exactly once."""
    width = params.attribution_days + 1
    odate = F.col("OutreachDate")
    p = pairs.select(*PAIR, "OutreachDate").withColumn("_bin", _bin(odate, width))
    sbin = _bin(F.col("ServiceStartDate"), width)
    s = services.select("User_ID", *SERVICE_COLS)
    if campaigns is not None:
        # only services between the first outreach date and the last one plus
        # the window can match: two scalar subqueries over the small campaign table
        bounds = campaigns.select(F.struct(F.min("OutreachDate").alias("lo"),
                                           F.date_add(F.max("OutreachDate"), params.attribution_days).alias("hi"))
                                  ).scalar()
        s = s.where(F.col("ServiceStartDate").between(bounds.getField("lo"), bounds.getField("hi")))
    s = s.withColumn("_bin", F.explode(F.array(sbin - 1, sbin)))
    start = F.col("ServiceStartDate")
    return (p.join(s, ["User_ID", "_bin"], "inner")
            .where((start >= odate) & (days_between(start, odate) <= params.attribution_days))
            .drop("_bin"))


def touch_matches(pairs: DataFrame, services: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Day-level matches of touches and services: ``User_ID, OutreachDate``,
    the first service of the window (struct ``_s``) and the campaign it is
    credited to (``_credit``: NULL when an earlier touch has it).

    Only days matter, so each side is first reduced to one row per user and
    day: services to the first of the day, touches to the first campaign of
    the day.  A bin of ``window + 1`` days then holds at most that many touch
    days and each meets at most twice as many service days, whatever the
    user's history."""
    width = params.attribution_days + 1
    ranked = ["ServiceStartDate", "Service_ID"] + [c for c in SERVICE_COLS if c not in ("ServiceStartDate", "Service_ID")]
    touches = (pairs.where(F.col("User_ID").isNotNull() & F.col("OutreachDate").isNotNull())
               .groupBy("User_ID", "OutreachDate").agg(F.min("Campaign_ID").alias("_first"))
               .withColumn("_bin", _bin(F.col("OutreachDate"), width)))
    start = F.col("ServiceStartDate")
    days = (services.where(F.col("User_ID").isNotNull() & start.isNotNull())
            .groupBy("User_ID", "ServiceStartDate").agg(F.min(F.struct(*ranked)).alias("_s"))
            .withColumn("_bin", F.explode(F.array(_bin(start, width) - 1, _bin(start, width)))))
    near = touches.join(days, ["User_ID", "_bin"]).where(
        (start >= F.col("OutreachDate")) & (days_between(start, "OutreachDate") <= params.attribution_days))
    best = near.groupBy("User_ID", "OutreachDate").agg(F.min("_s").alias("_s"), F.first("_first").alias("_first"))
    first_touch = near.groupBy("User_ID", "ServiceStartDate").agg(F.min("OutreachDate").alias("_first_date"))
    return (best.withColumn("ServiceStartDate", F.col("_s.ServiceStartDate"))
            .join(first_touch, ["User_ID", "ServiceStartDate"])
            .select("User_ID", "OutreachDate", "_s",
                    F.when(F.col("_first_date") == F.col("OutreachDate"), F.col("_first")).alias("_credit")))


#: Days of one range of the sweep; more ranges copy more border rows.
RANGE_DAYS = 366


def _swept(touches: DataFrame, services: DataFrame, params: Params) -> DataFrame:
    """``touches`` (with ``User_ID``, ``OutreachDate``, ``Campaign_ID``) with
    the first service of the window (struct ``_s``) and whether no earlier
    touch has it (``_first_touch``).  No two touches of a user may agree on
    date and campaign."""
    window, width = params.attribution_days, max(RANGE_DAYS, params.attribution_days + 1)
    start = F.col("ServiceStartDate")
    ranked = ["ServiceStartDate", "Service_ID"] + [c for c in SERVICE_COLS if c not in ("ServiceStartDate", "Service_ID")]
    firsts = (services.where(F.col("User_ID").isNotNull() & start.isNotNull())
              .groupBy("User_ID", "ServiceStartDate").agg(F.min(F.struct(*ranked)).alias("_service")))
    days = firsts.select("User_ID", F.col("ServiceStartDate").alias("_day"), "_service", F.explode(F.array_distinct(F.array(
        _bin(start, width), _bin(F.date_sub(start, window), width)))).alias("_range"))
    date = F.col("OutreachDate")
    own, after = _bin(date, width), _bin(F.date_add(date, window), width)
    # a touch without a date meets nothing, and keeps its row
    places = F.when(after > own, F.array(own, after)).otherwise(F.array(own))
    marks = touches.select("*", date.alias("_day"), F.explode(places).alias("_range")).withColumn(
        "_touch", (F.col("_range") == F.coalesce(own, F.col("_range"))) | date.isNull()).withColumn("_touch_day", F.col("_day"))
    both = marks.unionByName(days, allowMissingColumns=True)
    order = Window.partitionBy("User_ID", "_range").orderBy(
        F.col("_day").desc(), F.col("_service").isNull(), F.col("Campaign_ID").desc())
    swept = both.select(
        "*", F.min("_service").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_next"),
        F.expr("lead(_touch_day) IGNORE NULLS OVER (PARTITION BY User_ID, _range "
               "ORDER BY _day DESC, _service IS NULL, Campaign_ID DESC)").alias("_touch_before"))
    near = days_between(F.col("_next.ServiceStartDate"), date) <= window
    own_s = F.when(near, F.col("_next"))
    earlier = days_between(F.col("_next.ServiceStartDate"), "_touch_before") <= window
    return swept.where(F.coalesce("_touch", F.lit(False))).select(
        *touches.columns, own_s.alias("_s"), (~F.coalesce(earlier, F.lit(False))).alias("_first_touch"))


def attribution(campaigns: DataFrame, responses: DataFrame, services: DataFrame,
                params: Params = DEFAULT) -> DataFrame:
    """The attribution table: one row per kept (campaign, user) pair.  Of a
    campaign that occurs more than once, a pair takes the row with the first
    service (none first), then the first outreach date and attributes."""
    repeats = not campaigns.groupBy("Campaign_ID").count().where(F.col("count") > 1).isEmpty()
    if repeats:
        rest = [c for c in CAMPAIGN_COLS if c not in ("Campaign_ID", "OutreachDate")]
        campaigns = campaigns.groupBy("Campaign_ID", "OutreachDate").agg(F.min(F.struct(*rest)).alias("c")).select(
            "Campaign_ID", "OutreachDate", "c.*")
    rows = _swept(campaign_pairs(campaigns, responses), services, params).select(
        *CAMPAIGN_COLS, "User_ID", *RESPONSE_COLS, *[F.col(f"_s.{c}").alias(c) for c in SERVICE_COLS], "_first_touch")
    if repeats:
        order = ["ServiceStartDate", "Service_ID", "OutreachDate"]
        whole = F.struct(*order, *[c for c in rows.columns if c not in order])
        rows = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in PAIR]).agg(F.min(whole).alias("r")).select("r.*")
    out = rows.where(F.col("Service_ID").isNull() | F.col("_first_touch"))
    return out.select(*CAMPAIGN_COLS, "User_ID", *RESPONSE_COLS, *SERVICE_COLS,
                      F.when(F.col("Service_ID").isNotNull(), 1).otherwise(0).alias("Converted"))


def attribution_base(campaigns: DataFrame, responses: DataFrame, services: DataFrame,
                     params: Params = DEFAULT) -> DataFrame:
    """Every joined row before the filter, with both ranks as the reference
    defines them (for inspection of the attribution step). The ranks are
    per-group row numbers that split hot groups over several tasks
    (``ordered.group_window``): all unmatched pairs of one user share the
    (user, NULL service) group, which is large for a heavy user."""
    pairs = campaigns.select(*CAMPAIGN_COLS).join(responses.select(*PAIR, *RESPONSE_COLS), "Campaign_ID")
    keys = pairs.select(*PAIR, "OutreachDate").distinct()
    m = window_matches(keys, services, params, campaigns).drop("OutreachDate")
    rows = pairs.join(m, PAIR, "left").withColumn(
        "Converted", F.when(F.col("Service_ID").isNotNull(), 1).otherwise(0))
    rows = keep(rows, params.storage())   # read by two hot-key counts and the result
    r1 = group_window(rows, PAIR, ["ServiceStartDate", "Service_ID"]).select(
        *rows.columns, F.col("_rn").alias("Campaign_Service_Rank"))
    r2 = group_window(r1, ["User_ID", "Service_ID"], ["OutreachDate", "Campaign_ID"],
                      hot=hot_keys(rows, ["User_ID", "Service_ID"])).select(
        *r1.columns, F.col("_rn").alias("User_Service_Rank"))
    return r2.select(*CAMPAIGN_COLS, "User_ID", *RESPONSE_COLS, *SERVICE_COLS, "Converted",
                     "Campaign_Service_Rank", "User_Service_Rank")


def conversions_by_type(attr: DataFrame) -> DataFrame:
    """Attributed conversions and kept pairs per outreach type."""
    return attr.groupBy("OutreachType").agg(
        F.sum("Converted").alias("Conversions"), F.count(F.lit(1)).alias("Outreach_Pairs"))


def conversion_rate(attr: DataFrame) -> DataFrame:
    """Conversions over kept pairs per outreach type."""
    c = conversions_by_type(attr)
    return c.select("OutreachType", "Conversions", "Outreach_Pairs",
                    round_half_up(ratio("Conversions", "Outreach_Pairs"), 4).alias("Conversion_Rate"))


def conversion_crosstab(attr: DataFrame) -> DataFrame:
    """Converted pairs by outreach type x access channel x service type with
    the median days from outreach to service."""
    conv = attr.where(F.col("Converted") == 1).withColumn(
        "Days_To_Convert", days_between("ServiceStartDate", "OutreachDate"))
    return conv.groupBy("OutreachType", "AccessChannel", "ServiceType").agg(
        F.count(F.lit(1)).alias("Conversions"),
        quantile("Days_To_Convert", 0.5).cast("int").alias("Median_Days_To_Convert"))
