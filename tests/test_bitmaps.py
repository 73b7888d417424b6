"""Distinct counts by bitmaps equal COUNT(DISTINCT)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.operators.bitmaps import BITS_PER_ROW, count_bitmaps, distinct_keys, is_dense, key_bitmaps, merge_bitmaps

LOW, HIGH = -(1 << 63), (1 << 63) - 1
EDGES = [None, 0, 1, -1, 32_767, 32_768, 32_769, -32_767, -32_768, -32_769, LOW, LOW + 1, HIGH, HIGH - 1]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]),
                          st.one_of(st.sampled_from(EDGES), st.integers(-70_000, 70_000))), max_size=60))
def test_counts_of_groups(spark, rows):
    df = spark.createDataFrame(rows, "g string, k long").repartition(3)
    got = {r.g: r.n for r in count_bitmaps(key_bitmaps(df, "k", ("g",)), "n", ("g",)).collect()}
    want = {}
    for g, k in rows:
        if k is not None:
            want.setdefault(g, set()).add(k)
    assert got == {g: len(keys) for g, keys in want.items()}


def test_stored_bitmaps_of_two_loads_merge(spark):
    one = key_bitmaps(spark.range(-500, 40_000).withColumnRenamed("id", "k"), "k")
    two = key_bitmaps(spark.range(39_000, 100_000).withColumnRenamed("id", "k"), "k")
    assert count_bitmaps(merge_bitmaps(one, two), "n").first().n == 100_500


def test_dense_sparse_empty_and_other_keys(spark):
    keys = spark.range(1000).withColumn("k", F.when(F.col("id") % 10 == 0, None).otherwise(F.expr("id div 2")))
    check = lambda df, key: tuple(distinct_keys(df, key, "a", "d").first())
    assert is_dense(keys, "k") and check(keys, "k") == (900, 500)
    sparse = keys.withColumn("k", F.col("k") * (BITS_PER_ROW * 10) - 3)
    assert not is_dense(sparse, "k") and check(sparse, "k") == (900, 500)
    extremes = spark.createDataFrame([(LOW,), (HIGH,), (HIGH,), (None,)], "k long")
    assert not is_dense(extremes, "k") and check(extremes, "k") == (3, 2)
    assert check(keys.withColumn("k", F.col("k").cast("string")), "k") == (900, 500)
    assert check(keys.where("k < 0"), "k") == check(keys.where("id % 10 = 0"), "k") == (0, 0)


def test_one_hot_key_is_combined_before_the_shuffle(spark):
    df = spark.range(30_000).select(F.when(F.col("id") < 10_000, 7).otherwise(F.col("id")).alias("k")).repartition(4)
    result = distinct_keys(df, "k", "a", "d")
    assert tuple(result.first()) == (30_000, 20_001)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_construct_agg" in plan
