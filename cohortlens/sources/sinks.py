"""Create-table-as writers: the reference's ``CREATE TABLE t AS`` fails when
the table exists, so the default mode is ``errorifexists``."""

from __future__ import annotations

from pyspark.sql import DataFrame


def create_table_as(df: DataFrame, path: str, mode: str = "errorifexists",
                    partition_by: list[str] | None = None) -> None:
    """Write a derived table as Parquet (no sort: order is not part of a table)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def save_as_table(df: DataFrame, name: str, mode: str = "errorifexists",
                  bucket_by: tuple[int, str] | None = None) -> None:
    """Write to the session catalog, optionally bucketed by User_ID so that
    later user-grain joins read co-partitioned data without a shuffle."""
    w = df.write.mode(mode).format("parquet")
    if bucket_by:
        n, col = bucket_by
        w = w.bucketBy(n, col).sortBy(col)
    w.saveAsTable(name)
