"""Readers for the base tables stored as CSV (the reference's sample format)
or Parquet."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cohortlens.sources import schemas
from cohortlens.sources.tables import Tables

# Sample-file layout of the reference (header row, M/d/yy dates).
CSV_OPTIONS = {"header": "true", "dateFormat": "M/d/yy", "mode": "FAILFAST", "enforceSchema": "false"}


def read_csv(spark: SparkSession, path: str, table: str):
    """One base table from CSV with its explicit schema; malformed rows fail
    the read instead of turning into NULLs, and so does a header whose names
    differ from the schema's or stand in another order.  Only the columns that
    a query reads are parsed and checked."""
    return spark.read.schema(schemas.BY_NAME[table]).options(**CSV_OPTIONS).csv(path)


def read_csv_tables(spark: SparkSession, paths: dict[str, str]) -> Tables:
    return Tables(**{name: read_csv(spark, paths[name], name) for name in schemas.BY_NAME})


def read_parquet_tables(spark: SparkSession, root: str) -> Tables:
    """Base tables stored as ``<root>/<table>`` Parquet datasets."""
    return Tables(**{name: spark.read.parquet(f"{root}/{name}") for name in schemas.BY_NAME}).conformed()
