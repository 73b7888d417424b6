"""Exact medians of large groups without holding a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_median(df: DataFrame, key: str, value: str, out: str, accuracy: int = 10_000) -> DataFrame:
    """``(key, out)``: the discrete median of ``value`` per ``key`` (NULL
    values skipped; a group without any has NULL).

    A mergeable sketch brackets the median, rows below the bracket are only
    counted, and the few distinct values inside it (a share of about ``4 /
    accuracy`` of the group) are ranked.  ``df`` is read twice; the number of
    keys should be small, as the brackets are broadcast."""
    known = df.where(F.col(value).isNotNull()).select(key, value)
    share = 2.0 / accuracy
    ends = known.groupBy(F.col(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx(value, [0.5 - share, 0.5 + share], accuracy).alias("_ends"))
    inside = known.join(F.broadcast(ends), F.col(key).eqNullSafe(F.col("_key"))).select(
        key, value, "_n", F.col("_ends")[0].alias("_low"), F.col("_ends")[1].alias("_high"))
    # values under the bracket are counted in one row, which sorts first
    at = F.when(F.col(value) >= F.col("_low"), F.col(value))
    counts = inside.where(F.col(value) <= F.col("_high")).groupBy(F.col(key).alias("_key"), at.alias("_at")).agg(
        F.count(F.lit(1)).alias("_rows"), F.first("_n").alias("_n"))
    seen = F.sum("_rows").over(Window.partitionBy("_key").orderBy(F.col("_at").asc_nulls_first()))
    ranked = counts.select("_key", "_at", seen.alias("_seen"), "_n").where(2 * F.col("_seen") >= F.col("_n"))
    medians = ranked.groupBy("_key").agg(F.min("_at").alias(out))
    return df.select(key).distinct().join(
        F.broadcast(medians), F.col(key).eqNullSafe(F.col("_key")), "left").select(key, out)
