"""Hot-key splitting of per-group windows gives the plain window's answer."""

from pyspark.sql import functions as F

from cohortlens.operators import ordered, sequence
from cohortlens.sources import testdata

COLS = dict(lag=["d"], lead=["t", "d"], first=["t", "c"], second=["t"])


def _rows(df):
    return sorted(tuple(repr(v) for v in r) for r in df.collect())


def test_split_matches_plain_window(spark):
    # user 0 holds most rows, users 1..20 a few each
    df = spark.range(3000).select(
        F.when(F.col("id") < 2400, F.lit(0)).otherwise(F.col("id") % 20 + 1).alias("u"),
        F.col("id").alias("q"),
        F.pmod(F.xxhash64("id"), F.lit(50)).cast("int").alias("d"),
        F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("t"),
        F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("c"))
    plain = ordered.group_window(df, "u", ["d", "q"], hot=[], **COLS)
    hot = ordered.hot_keys(df, "u", hot_rows=100)
    assert hot and hot[0][0] == 0
    split = ordered.group_window(df, "u", ["d", "q"], hot=hot, rows_per_part=150, **COLS)
    assert split.columns == plain.columns
    assert _rows(split) == _rows(plain)


def test_split_plan_partitions_by_key_and_part(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("u"), F.col("id").alias("q"))
    out = ordered.group_window(df, "u", ["q"], hot=[(0, 250), (1, 250)], rows_per_part=50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(u#" in plan and "_part" in plan


def test_sequence_and_cadence_with_hot_users(spark):
    t = testdata.load(spark, "/root/testdata/sf0.01")
    hot = ordered.hot_keys(t.services, "User_ID", hot_rows=5)
    assert len(hot) > 64
    assert _rows(sequence.service_sequence(t.services, hot=hot)) == _rows(sequence.service_sequence(t.services, hot=[]))
    assert _rows(sequence.service_cadence(t.services, hot=hot)) == _rows(sequence.service_cadence(t.services, hot=[]))


def test_split_with_range_table_matches_plain(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") < 3000, F.lit(0)).otherwise(F.col("id") % 10 + 1).alias("u"),
        F.col("id").alias("q"), F.pmod(F.xxhash64("id"), F.lit(90)).cast("int").alias("d"),
        F.concat(F.lit("t"), (F.col("id") % 5).cast("string")).alias("t"), F.lit("c").alias("c"))
    plain = ordered.group_window(df, "u", ["d", "q"], hot=[], **COLS)
    hot = ordered.hot_keys(df, "u", hot_rows=50)
    split = ordered.group_window(df, "u", ["d", "q"], hot=hot, rows_per_part=20, **COLS)   # ~200 parts
    assert _rows(split) == _rows(plain)
