"""Exact distinct counts of integer keys by partitioned bitmaps.

A key is a bucket number and a bit position in the bucket's 4 KB bitmap.
Bitmaps of one bucket combine before the shuffle, so what is shuffled is
bounded by the range of the keys, not by the rows, and no task holds the set
of all keys.  Stored bitmaps of two loads merge, so the count of a growing
table needs the new rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Bits of bitmap a row may cost before its keys count as sparse: the size of
#: a long key, so that bitmaps are never larger than the keys themselves.
BITS_PER_ROW = 64


def key_bitmaps(df: DataFrame, key: str, by: tuple = ()) -> DataFrame:
    """``*by, bucket, bits``: the keys of each group as bitmaps.  NULL keys set
    no bit; a NULL in ``by`` is a group of its own.  A bitmap has 4 KB however few
    keys it holds: meant for groups whose keys are dense (see ``is_dense``)."""
    value = F.col(key).cast("long")
    return df.where(F.col(key).isNotNull()).groupBy(*by, F.bitmap_bucket_number(value).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits"))


def merge_bitmaps(*parts: DataFrame, by: tuple = ()) -> DataFrame:
    """The union of the keys of several ``key_bitmaps`` results."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_bitmaps(bitmaps: DataFrame, name: str, by: tuple = ()) -> DataFrame:
    """``*by, name``: the number of different keys (without ``by`` one row,
    0 for no bitmaps)."""
    return bitmaps.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias(name))


def is_dense(df: DataFrame, key: str) -> bool:
    """Whether bitmaps suit the keys: integers whose range spans at most
    ``BITS_PER_ROW`` numbers a row.  One job over the key column."""
    if not isinstance(df.schema[key].dataType, INTEGERS):
        return False
    wide = F.col(key).cast("decimal(20,0)")
    span, rows = df.agg(F.max(wide) - F.min(wide), F.count(key)).first()
    return rows == 0 or span <= BITS_PER_ROW * rows


def distinct_keys(df: DataFrame, key: str, all_name: str, distinct_name: str) -> DataFrame:
    """One row as ``quality.key_uniqueness`` gives it: bitmaps for dense
    integer keys, ``count_distinct`` for others (both exact)."""
    if not is_dense(df, key):
        return df.agg(F.count(key).alias(all_name), F.count_distinct(key).alias(distinct_name))
    # the bitmaps carry the rows of their bucket, so the keys are read once
    value = F.col(key).cast("long")
    buckets = df.where(F.col(key).isNotNull()).groupBy(F.bitmap_bucket_number(value).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits"))
    return buckets.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias(all_name),
                       F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias(distinct_name))
