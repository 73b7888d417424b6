"""Adapter from the driver's TPC-H-like tables to the five base tables.

The mapping is the one written down in FIXTURES.md §3. Every table is derived
lazily from the Parquet scans, so Catalyst prunes the scanned columns and the
adapter's work grows with the input. Money sums run in DECIMAL at a scale that
keeps the input's digits, so they are independent of summation order.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.exprs import EXACT
from cohortlens.sources import schemas
from cohortlens.sources.tables import conform


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(key: Column, pairs, default=None) -> Column:
    expr = None
    for k, v in pairs:
        expr = (F.when(key == k, v) if expr is None else expr.when(key == k, v))
    return expr if default is None else expr.otherwise(default)


# The labels, thresholds and moduli below are fixed values of the TESTDATA
# mapping written down in FIXTURES.md §3; the oracle SQL repeats them.


def users(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    c = customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    k = F.col("c_custkey")
    bal = F.col("c_acctbal")
    return (c.join(geo, c.c_nationkey == geo.n_nationkey)
            .select(
                k.alias("User_ID"),
                F.when(k % 97 == 0, F.lit(16)).otherwise((18 + k % 60).cast("int")).alias("Age"),
                F.when(k % 2 == 0, "Female").otherwise("Male").alias("Gender"),
                F.col("c_mktsegment").alias("EmploymentStatus"),
                F.when(bal < 1000, "Low").when(bal < 3000, "Lower-middle").when(bal < 6000, "Middle")
                 .when(bal < 8500, "Upper-middle").otherwise("High").alias("IncomeBracket"),
                F.col("r_name").alias("Region"),
                F.col("n_name").alias("City"),
                (1 + k % 8).cast("int").alias("HouseholdSize")))


def services(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("date")
    kind = _case(F.col("o_orderpriority"), [
        ("1-URGENT", "Telehealth Consultation"),
        ("2-HIGH", "Follow-up Appointment"),
        ("3-MEDIUM", "Preventive Screening"),
        ("4-NOT SPECIFIED", "Medication Support"),
    ], F.when(key % 2 == 0, "Vaccination").otherwise("Subscription Benefit"))
    channel = _case(key % 4, [(0, "Direct Digital"), (1, "Partner Plan"), (2, "Community Program")],
                    F.lit("Pharmacy Partner"))
    # a finished order is an ended service, any other one is ongoing
    ended = F.col("o_orderstatus") == "F"
    return orders.select(
        F.col("o_custkey").alias("User_ID"),
        key.alias("Service_ID"),
        start.alias("ServiceStartDate"),
        F.when(ended, F.date_add(start, (30 + key % 90).cast("int"))).alias("ServiceEndDate"),
        F.col("o_totalprice").alias("ServiceFee"),
        kind.alias("ServiceType"),
        channel.alias("AccessChannel"))


def app_usage(events: DataFrame) -> DataFrame:
    purchase = F.col("event_type") == "purchase"
    money = F.col("value").cast(EXACT)
    day = F.col("ts").cast("date")
    spend = F.sum(F.when(purchase, money))
    agg = (events.groupBy("user_id")
           .agg((F.sum(money).cast("double") / F.count("value")).alias("AvgSessionMinutes"),
                spend.alias("spend"),
                F.min(F.when(purchase, day)).alias("first_purchase"),
                F.min(day).alias("install"),
                F.max(F.when(purchase, day)).alias("LastServiceDate")))
    uid = F.col("user_id")
    return agg.select(
        uid.alias("User_ID"),
        "AvgSessionMinutes",
        F.when(F.col("spend") > 800, "High").when(F.col("spend") > 500, "Medium")
         .when(F.col("spend") > 0, "Low").otherwise("None").alias("SpendingSegment"),
        F.col("spend").cast("double").alias("TelehealthSpend"),
        F.datediff("first_purchase", "install").alias("FirstPurchaseDaysAfterInstall"),
        _case(uid % 3, [(0, "Credit Card"), (1, "PayPal")], F.lit("Debit Card")).alias("PaymentMethod"),
        "LastServiceDate")


def campaigns(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    kind = _case(F.col("s_nationkey") % 6, [(0, "SMS"), (1, "Email"), (2, "App Push"),
                                            (3, "Community Event"), (4, "Social")], F.lit("Partner Referral"))
    return supplier.select(
        k.alias("Campaign_ID"),
        kind.alias("OutreachType"),
        F.date_add(F.lit("1995-01-01").cast("date"), (k * 37 % 2400).cast("int")).alias("OutreachDate"),
        F.col("s_acctbal").alias("OutreachBudget"),
        _case(k % 3, [(0, "General"), (1, "New Users")], F.lit("Chronic Care")).alias("TargetSegment"))


#: Rows of ``lineitem`` a task of the responses' aggregation takes.
ROWS_PER_PART = 500_000
MAX_PARTS = 65_536


def responses(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per (customer, supplier).  Parts that are cut by their bytes hold
    millions of these narrow rows, and a consumer that groups by the pair keeps
    hash tables of its own over the same part; so where the rows exceed
    ``ROWS_PER_PART`` a task they are dealt by pair into parts of about that
    many, which such consumers take over without a shuffle."""
    li = lineitem.select("l_orderkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")
    o = orders.select("o_orderkey", "o_custkey")
    rows = li.join(o, li.l_orderkey == o.o_orderkey)
    spark = lineitem.sparkSession
    parts = min(MAX_PARTS, -(-lineitem.count() // ROWS_PER_PART))
    if parts > min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))):
        rows = rows.repartition(parts, "o_custkey", "l_suppkey")
    return (rows.groupBy(F.col("o_custkey").alias("User_ID"), F.col("l_suppkey").alias("Campaign_ID"))
            .agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("ResponseFlag"),
                 F.max("l_discount").alias("CTR"),
                 F.sum("l_quantity").cast("bigint").alias("EngagementCount")))


class TestTables:
    """The five base tables derived from a folder's Parquet files.  Each is
    built when first asked for, so a query opens only the files it reads."""

    __test__ = False  # no test class
    bucketed = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._file = lambda name: _read(spark, sf_dir, name)

    @cached_property
    def users(self) -> DataFrame:
        return conform("users", users(self._file("customer"), self._file("nation"), self._file("region")))

    @cached_property
    def services(self) -> DataFrame:
        return conform("services", services(self._file("orders")))

    @cached_property
    def app_usage(self) -> DataFrame:
        return conform("app_usage", app_usage(self._file("events")))

    @cached_property
    def campaigns(self) -> DataFrame:
        return conform("campaigns", campaigns(self._file("supplier")))

    @cached_property
    def responses(self) -> DataFrame:
        return conform("responses", responses(self._file("lineitem"), self._file("orders")))

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in schemas.BY_NAME}


def load(spark: SparkSession, sf_dir: str) -> TestTables:
    """The five base tables derived from ``sf_dir``'s Parquet files, as lazy
    DataFrames."""
    return TestTables(spark, sf_dir)
