"""Data-quality checks: null counts per column and key uniqueness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: ``<column>_nulls`` for every column (one scan, one aggregate)."""
    cols = columns or df.columns
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in cols])


def key_uniqueness(df: DataFrame, key: str, all_name: str, distinct_name: str) -> DataFrame:
    """One row: non-NULL key count and exact distinct key count."""
    return df.agg(F.count(key).alias(all_name), F.count_distinct(key).alias(distinct_name))


def assert_unique(df: DataFrame, key: str) -> None:
    """Fail loudly when ``key`` repeats (user-grain joins would fan out)."""
    dup = df.groupBy(key).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"{key} is not unique: {dup[0][key]!r} repeats")
