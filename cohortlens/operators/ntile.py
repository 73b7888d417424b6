"""Distributed ``NTILE(k) OVER (ORDER BY v)``.

Spark plans a window without ``PARTITION BY`` as one single-partition
exchange: every row goes through one task. Here the global order of the
unique key ``(v, id)`` is cut into B ranges instead:

1. a deterministic hash sample of ``id`` (a few dozen rows per range) is
   sorted and B - 1 split keys are taken from it;
2. each row's range is found by ``assign_ranges``: a small tree of
   comparisons for a few dozen splits, otherwise a tree to a coarse bucket
   and a broadcast equi join against the bounded table of fine ranges
   (built-in expressions only, none growing with B);
3. rows per range are counted (B small rows to the driver) and turned into
   offsets;
4. the ranks at which SQL's NTILE starts its tiles are known from n and k
   (the first n mod k tiles get one extra row); only the ranges that hold
   such a rank are sorted, and the k - 1 boundary keys come to the driver;
5. each row's tile is the number of boundary keys up to its own key, plus 1:
   the result has no window and no shuffle.

Splitting on ``(v, id)`` rather than ``v`` spreads heavy ties over several
ranges. Struct comparison puts NULL first, as ``ORDER BY v ASC`` does. Nothing
depends on partition ids, so recomputation after an executor loss gives the
same answer.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.scope import keep

ROWS_PER_RANGE = 2_000_000
MIN_RANGES = 8
MAX_RANGES = 65_536
SAMPLE_PER_RANGE = 40


def sql_order_key(value):
    """Python sort key that orders values as Spark's ``ASC NULLS FIRST``:
    NULL first, NaN above every number, -0.0 equal to 0.0; strings compare
    by code point, which is Spark's UTF-8 byte order."""
    if value is None:
        return (0, 0, 0)
    if isinstance(value, float):
        return (1, 1, 0) if math.isnan(value) else (1, 0, value + 0.0)
    return (1, 0, value)


def _range_of(key: Column, splits: list[Column]) -> Column:
    """Number of split keys <= key, by binary search over sorted splits (a
    tree of comparisons; meant for a few dozen splits)."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= splits[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))
    return tree(0, len(splits))


TREE_SPLITS = 48   # above this the lookup goes through a broadcast range table


def assign_ranges(df: DataFrame, key: Column, split_values: list[tuple], types: list, out: str,
                  when: Column | None = None) -> DataFrame:
    """Add ``out`` = number of split keys <= ``key`` (a struct with fields
    k0, k1, ... of ``types``), NULL where ``when`` is false.

    Few splits: one comparison tree. Many splits: a coarse bucket from every
    G-th split (G about sqrt of the count, so a tree of a few dozen
    comparisons), then a broadcast equi join on the bucket against the table
    of fine ranges [lo, hi) with the bounds as a residual, so every row checks
    at most G ranges and no expression grows with the number of ranges (one
    huge expression would exceed the JVM's method size and lose code
    generation). The range table has one row per range: bounded by the range
    cap."""
    lit = lambda vals: F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(vals, types))])
    n = len(split_values)
    if n <= TREE_SPLITS:
        r = _range_of(key, [lit(v) for v in split_values])
        return df.withColumn(out, r if when is None else F.when(when, r))
    g = math.ceil(math.sqrt(n))
    coarse = [lit(split_values[j]) for j in range(g - 1, n, g)]
    c = _range_of(key, coarse)
    key_type = T.StructType([T.StructField(f"k{i}", t) for i, t in enumerate(types)])
    table = df.sparkSession.createDataFrame(
        [(r // g, split_values[r - 1] if r > 0 else None, split_values[r] if r < n else None, r)
         for r in range(n + 1)],
        T.StructType([T.StructField("_rc", T.LongType()), T.StructField("_lo", key_type),
                      T.StructField("_hi", key_type), T.StructField(out, T.IntegerType())]))
    x = df.withColumn("_rc_row", c if when is None else F.when(when, c)).withColumn("_rkey", key)
    cond = ((F.col("_rc_row") == F.col("_rc"))
            & (F.col("_lo").isNull() | (F.col("_rkey") >= F.col("_lo")))
            & (F.col("_hi").isNull() | (F.col("_rkey") < F.col("_hi"))))
    joined = x.join(F.broadcast(table), cond, "inner" if when is None else "left")
    return joined.drop("_rc_row", "_rkey", "_rc", "_lo", "_hi")


def _tile_starts(n: int, k: int) -> list[int]:
    """0-based global ranks at which the tiles 2..k of ``NTILE(k)`` begin: the
    first ``n mod k`` tiles hold one row more."""
    q, rem = divmod(n, k)
    return [s for s in ((t * q + min(t, rem)) for t in range(1, k)) if s < n]


def ntiles(df: DataFrame, specs: list[tuple[str, str]], k: int, id_col: str,
           rows_per_range: int = ROWS_PER_RANGE, min_ranges: int = MIN_RANGES,
           max_ranges: int = MAX_RANGES, persist: bool | StorageLevel = True) -> DataFrame:
    """Add one ``NTILE(k)`` column per ``(out_name, value_col)`` spec, each
    ordered by ``value_col ASC NULLS FIRST, id_col``. The input is read by
    several jobs, so it is persisted (``persist``: True, False or a
    StorageLevel). The result itself has no window and no shuffle: each row is
    compared with the ``k - 1`` boundary keys."""
    level = StorageLevel.MEMORY_AND_DISK if persist is True else persist
    base = keep(df, level) if level else df
    n = base.count()
    if n == 0:
        return base.select("*", *[F.lit(None).cast("int").alias(o) for o, _ in specs])
    ranges = max(min_ranges, min(max_ranges, math.ceil(n / rows_per_range)))
    modulus = max(1, n // (ranges * SAMPLE_PER_RANGE))
    # one bounded sample (about SAMPLE_PER_RANGE rows per range) serves every spec
    value_cols = list(dict.fromkeys(v for _, v in specs))
    sample = base.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(modulus)) == 0) \
        .select(id_col, *value_cols).limit(2 * ranges * SAMPLE_PER_RANGE).collect()
    itype = base.schema[id_col].dataType

    ranged = base
    for j, (_, v) in enumerate(specs):
        vtype = base.schema[v].dataType
        keys = sorted(((r[v], r[id_col]) for r in sample),
                      key=lambda kv: (sql_order_key(kv[0]), sql_order_key(kv[1])))
        picks = sorted({len(keys) * i // ranges for i in range(1, ranges)} - {0}) if keys else []
        key = F.struct(F.col(v).alias("k0"), F.col(id_col).alias("k1"))
        ranged = assign_ranges(ranged, key, [keys[p] for p in picks], [vtype, itype], f"_r{j}")

    counted = ranged.select(F.explode(F.array(*[F.struct(F.lit(j).alias("d"), F.col(f"_r{j}").alias("r"))
                                                for j in range(len(specs))])).alias("x")) \
        .groupBy("x.d", "x.r").count().collect()
    out = base
    for j, (name, v) in enumerate(specs):
        sizes = {row["r"]: row["count"] for row in counted if row["d"] == j}
        # the range and the place in it of the first row of each tile
        places, acc, starts = [], 0, _tile_starts(n, k)
        for r in range(max(sizes) + 1):
            places += [(r, s - acc + 1) for s in starts if acc <= s < acc + sizes.get(r, 0)]
            acc += sizes.get(r, 0)
        w = Window.partitionBy(f"_r{j}").orderBy(F.col(v).asc_nulls_first(), F.col(id_col).asc_nulls_first())
        if not places:
            out = out.withColumn(name, F.lit(1))
            continue
        near = ranged.where(F.col(f"_r{j}").isin([r for r, _ in places])).select(
            f"_r{j}", v, id_col, F.row_number().over(w).cast("bigint").alias("_place"))
        hit = F.lit(False)
        for r, place in places:
            hit = hit | ((F.col(f"_r{j}") == r) & (F.col("_place") == place))
        bounds = sorted(((row[v], row[id_col]) for row in near.where(hit).collect()),
                        key=lambda kv: (sql_order_key(kv[0]), sql_order_key(kv[1])))
        vtype = base.schema[v].dataType
        splits = [F.struct(F.lit(a).cast(vtype).alias("k0"), F.lit(b).cast(itype).alias("k1")) for a, b in bounds]
        key = F.struct(F.col(v).alias("k0"), F.col(id_col).alias("k1"))
        out = out.withColumn(name, (_range_of(key, splits) + 1).cast("int"))
    return out
