"""Explicit schemas of the five base tables (types inferred from the data
dictionary and the sample files; never inferred at read time)."""

from pyspark.sql import types as T

USERS = T.StructType([
    T.StructField("User_ID", T.LongType()),
    T.StructField("Age", T.IntegerType()),
    T.StructField("Gender", T.StringType()),
    T.StructField("EmploymentStatus", T.StringType()),
    T.StructField("IncomeBracket", T.StringType()),
    T.StructField("Region", T.StringType()),
    T.StructField("City", T.StringType()),
    T.StructField("HouseholdSize", T.IntegerType()),
])

SERVICES = T.StructType([
    T.StructField("User_ID", T.LongType()),
    T.StructField("Service_ID", T.LongType()),
    T.StructField("ServiceStartDate", T.DateType()),
    T.StructField("ServiceEndDate", T.DateType()),
    T.StructField("ServiceFee", T.DoubleType()),
    T.StructField("ServiceType", T.StringType()),
    T.StructField("AccessChannel", T.StringType()),
])

APP_USAGE = T.StructType([
    T.StructField("User_ID", T.LongType()),
    T.StructField("AvgSessionMinutes", T.DoubleType()),
    T.StructField("SpendingSegment", T.StringType()),
    T.StructField("TelehealthSpend", T.DoubleType()),
    T.StructField("FirstPurchaseDaysAfterInstall", T.IntegerType()),
    T.StructField("PaymentMethod", T.StringType()),
    T.StructField("LastServiceDate", T.DateType()),
])

CAMPAIGNS = T.StructType([
    T.StructField("Campaign_ID", T.LongType()),
    T.StructField("OutreachType", T.StringType()),
    T.StructField("OutreachDate", T.DateType()),
    T.StructField("OutreachBudget", T.DoubleType()),
    T.StructField("TargetSegment", T.StringType()),
])

RESPONSES = T.StructType([
    T.StructField("User_ID", T.LongType()),
    T.StructField("Campaign_ID", T.LongType()),
    T.StructField("ResponseFlag", T.IntegerType()),
    T.StructField("CTR", T.DoubleType()),
    T.StructField("EngagementCount", T.LongType()),
])

BY_NAME = {
    "users": USERS,
    "services": SERVICES,
    "app_usage": APP_USAGE,
    "campaigns": CAMPAIGNS,
    "responses": RESPONSES,
}
