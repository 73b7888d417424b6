"""Base tables stored by user.

The four tables with a ``User_ID`` are catalog tables in one number of
buckets, so joins, groupings and windows per user read them co-partitioned:
the reports' plans hold no exchange on ``User_ID``.  What is paid once is the
shuffle of the write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.ordered import ROWS_PER_PART, hot_keys
from cohortlens.sources import schemas
from cohortlens.sources.sinks import save_as_table
from cohortlens.sources.tables import Tables, conform

KEY = "User_ID"
BY_USER = tuple(name for name, schema in schemas.BY_NAME.items() if KEY in schema.names)


def _dealt(df: DataFrame, buckets: int, rows_per_part: int, hot_rows: int | None) -> DataFrame:
    """``df`` with about one task per bucket, so that a bucket is one file.

    A bucket's number is Spark's own hash of the key.  Rows of a user above
    ``hot_rows`` rows are dealt over more tasks by a hash of the row: their
    bucket gets several files, and no task writes a large part of the table."""
    bucket = F.pmod(F.hash(KEY), F.lit(buckets))
    hot = hot_keys(df, KEY, hot_rows)
    if not hot:
        return df.repartition(buckets, bucket)
    parts = -(-sum(rows for _, rows in hot) // rows_per_part)
    # every hot key has more than hot_rows rows, which bounds the list
    is_hot = F.struct(F.col(KEY)).isin([F.struct(F.lit(key).cast(df.schema[KEY].dataType)) for key, _ in hot])
    salt = F.when(is_hot, F.pmod(F.xxhash64(*df.columns), F.lit(parts))).otherwise(F.lit(0))
    return df.repartition(buckets + parts, bucket, salt)


def save_bucketed_tables(t: Tables, prefix: str, buckets: int, mode: str = "errorifexists",
                         rows_per_part: int = ROWS_PER_PART, hot_rows: int | None = None) -> None:
    """Write the base tables to the session catalog as ``<prefix>_<table>``:
    those with a User_ID in ``buckets`` buckets of it, the others plain."""
    for name, df in t.as_dict().items():
        if name in BY_USER:
            save_as_table(_dealt(df, buckets, rows_per_part, hot_rows), f"{prefix}_{name}", mode, (buckets, KEY))
        else:
            save_as_table(df, f"{prefix}_{name}", mode)


def _layout(spark: SparkSession, table: str) -> tuple[str | None, str | None]:
    facts = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    return facts.get("Num Buckets"), facts.get("Bucket Columns")


def read_bucketed_tables(spark: SparkSession, prefix: str) -> Tables:
    """The tables of ``save_bucketed_tables``.  Tables that are not all in the
    same number of buckets of User_ID are refused: their joins would shuffle
    again without a word."""
    layouts = {name: _layout(spark, f"{prefix}_{name}") for name in BY_USER}
    numbers = {number for number, _ in layouts.values()}
    if len(numbers) != 1 or any(columns != f"[`{KEY}`]" for _, columns in layouts.values()):
        raise ValueError(f"tables are not in one number of buckets of {KEY}: {layouts}")
    return Tables(**{name: conform(name, spark.table(f"{prefix}_{name}")) for name in schemas.BY_NAME}, bucketed=True)
