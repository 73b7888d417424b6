"""Per-group ordered windows that survive hot groups.

``Window.partitionBy(key)`` sends every row of a key through one task. When
one user holds a large share of all rows, that task sorts and scans the share
alone. ``group_window`` splits only such hot keys:

1. the keys above ``hot_rows`` rows are found with a partially aggregated
   count (a job that runs when the query is built; at most ``rows / hot_rows``
   keys);
2. a deterministic hash sample of their rows gives split keys on
   ``(key, order...)``; each hot row gets part ``1 + range`` through
   ``ntile.assign_ranges`` (comparison tree, or coarse tree plus broadcast
   range table for many parts), every other row part 0;
3. the window runs over ``(key, part)``, so no task holds more than about
   ``rows_per_part`` rows of a hot key;
4. a per-(key, part) table of hot parts only (bounded by ranges + hot keys)
   carries each part's size, first, second and last rows; a small window over
   it yields offsets and neighbours, and a broadcast join repairs ordinals,
   previous/next values and first/second values across part boundaries.

Without hot keys the plan is a single plain window. Nothing depends on
partition ids or row order on disk, so recomputation gives the same result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.ntile import assign_ranges, sql_order_key

HOT_ROWS = 2_000_000
ROWS_PER_PART = 1_000_000
MAX_PARTS = 65_536
SAMPLE_PER_PART = 20


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def hot_keys(df: DataFrame, key, hot_rows: int | None = None) -> list[tuple]:
    """(key value, rows) of every key above ``hot_rows`` rows (default
    ``HOT_ROWS``), heaviest first. This runs a job: a partially aggregated
    count, of which at most ``rows / hot_rows`` rows reach the driver. ``key``
    is a column name or a list of names (then the value is a tuple; NULL is a
    value). Pass the result on where several operators read one input."""
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    ks = _keys(key)
    rows = (df.groupBy(*ks).count().where(F.col("count") > hot_rows)
            .orderBy(F.col("count").desc(), *ks).collect())
    if isinstance(key, str):
        return [(r[key], r["count"]) for r in rows]
    return [(tuple(r[k] for k in ks), r["count"]) for r in rows]


def _key_struct(cols: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)])


def _lit_struct(values, types) -> Column:
    return F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(values, types))])


def group_window(df: DataFrame, key, order: list[str], lag: list[str] = (), lead: list[str] = (),
                 first: list[str] = (), second: list[str] = (), hot: list[tuple] | None = None,
                 rows_per_part: int | None = None, max_parts: int | None = None) -> DataFrame:
    """Add ``_rn`` (1-based position in the key's order), ``_prev_<c>`` /
    ``_next_<c>`` (previous / next row's value), ``_first_<c>`` (first row's
    value), ``_second_<c>`` (second row's value, NULL on the first row, as
    ``NTH_VALUE(c, 2)`` with the default frame) and ``_is_last``.

    ``key`` is a column name or a list of names (a NULL key value is a group
    of its own, as in ``PARTITION BY``). ``order`` should be unique within a
    key; rows tied on it are numbered in an unspecified order, as in SQL.
    ``hot`` is the output of ``hot_keys``; ``None`` detects them, ``[]`` skips
    splitting."""
    ks = _keys(key)
    rows_per_part = ROWS_PER_PART if rows_per_part is None else rows_per_part
    max_parts = MAX_PARTS if max_parts is None else max_parts
    if hot is None:
        hot = hot_keys(df, key)
    if not hot:
        w = Window.partitionBy(*ks).orderBy(*order)
        return df.select("*", *_window_cols(w, lag, lead, first, second, final=True))

    key_types = [df.schema[c].dataType for c in ks]
    hot_values = [h[0] for h in hot]
    hot_total = sum(h[1] for h in hot)
    parts = max(2, min(max_parts, math.ceil(hot_total / rows_per_part)))
    # rows tied on the order are split too: a hash of the row comes last
    tie = "_tie"
    names = df.columns
    df = _marked(df.withColumn(tie, F.xxhash64(*names)), key, ks, hot_values, key_types)
    order = [*order, tie]
    is_hot = F.col("_hot")
    sort_cols = [*ks, *order]
    sort_key = _key_struct(sort_cols)
    # a hash takes whole sets of equal rows, hence the hard bound on what the driver gets
    modulus = max(1, hot_total // (parts * SAMPLE_PER_PART))
    rows = (df.where(is_hot & (F.pmod(F.xxhash64(F.lit(7), F.col(tie)), F.lit(modulus)) == 0))
            .select(sort_key.alias("s")).limit(2 * parts * SAMPLE_PER_PART).collect())
    sample = sorted(rows, key=lambda r: tuple(sql_order_key(v) for v in r["s"]))
    picks = sorted({len(sample) * i // parts for i in range(1, parts)} - {0}) if sample else []
    types = [df.schema[c].dataType for c in sort_cols]
    x = assign_ranges(df, sort_key, [tuple(sample[p]["s"]) for p in picks], types, "_range", when=is_hot)
    x = x.withColumn("_part", F.coalesce(F.col("_range") + 1, F.lit(0))).drop("_range")

    w = Window.partitionBy(*ks, "_part").orderBy(*order)
    win = x.select("*", *_window_cols(w, lag, lead, first, second, final=False))

    # per hot part: size, first row, second row, last row
    first_fields = sorted(set(order) | set(lead) | set(first) | set(second))
    last_fields = sorted(set(order) | set(lag))
    row = lambda cols: F.struct(*[F.col(c).alias(c) for c in cols])
    b = win.where(F.col("_part") > 0).groupBy(*ks, "_part").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col("_w_rn") == 1, row(first_fields))).alias("_head"),
        F.max(F.when(F.col("_w_rn") == 2, row(first_fields))).alias("_head2"),
        F.max(F.when(F.col("_w_last"), row(last_fields))).alias("_tail"))
    wb = Window.partitionBy(*ks).orderBy("_part")
    whole = wb.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fix = b.select(
        *[F.col(c).alias(f"_fk_{c}") for c in ks], F.col("_part").alias("_fk_part"),
        F.coalesce(F.sum("_n").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.lag("_tail").over(wb).alias("_prev_tail"),
        F.lead("_head").over(wb).alias("_next_head"),
        F.first("_head").over(whole).alias("_g_head"),
        F.when(F.first("_n").over(whole) >= 2, F.first("_head2").over(whole))
         .otherwise(F.nth_value(F.col("_head"), 2).over(whole)).alias("_g_second"),
        F.lead("_part").over(wb).isNull().alias("_g_last_part"))
    cond = F.col("_part") == F.col("_fk_part")
    for c in ks:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_fk_{c}"))
    j = win.join(F.broadcast(fix), cond, "left")   # bounded: <= parts + hot keys rows

    hot_row = F.col("_g_head").isNotNull()
    rn = F.coalesce(F.col("_off"), F.lit(0)) + F.col("_w_rn")
    out = [rn.alias("_rn")]
    for c in lag:
        out.append(F.when((F.col("_w_rn") == 1) & F.col("_prev_tail").isNotNull(), F.col("_prev_tail")[c])
                   .otherwise(F.col(f"_w_prev_{c}")).alias(f"_prev_{c}"))
    for c in lead:
        out.append(F.when(F.col("_w_last") & F.col("_next_head").isNotNull(), F.col("_next_head")[c])
                   .otherwise(F.col(f"_w_next_{c}")).alias(f"_next_{c}"))
    for c in first:
        out.append(F.when(hot_row, F.col("_g_head")[c]).otherwise(F.col(f"_w_first_{c}")).alias(f"_first_{c}"))
    for c in second:
        out.append(F.when(rn == 1, F.lit(None)).when(hot_row, F.col("_g_second")[c])
                   .otherwise(F.col(f"_w_second_{c}")).alias(f"_second_{c}"))
    out.append(F.when(hot_row, F.col("_w_last") & F.col("_g_last_part")).otherwise(F.col("_w_last"))
               .alias("_is_last"))
    return j.select(*names, *out)


def _marked(df: DataFrame, key, ks: list[str], values: list, types: list) -> DataFrame:
    """Adds ``_hot``. A few keys are a literal list; more are a broadcast table
    (one row per key of more than ``HOT_ROWS`` rows)."""
    rows = [(v,) if isinstance(key, str) else tuple(v) for v in values]
    if len(rows) <= 64:
        # struct membership treats NULL fields as equal, so a NULL key can be hot
        return df.withColumn("_hot", _key_struct(ks).isin([_lit_struct(r, types) for r in rows]))
    table = df.sparkSession.createDataFrame([(*r, True) for r in rows], T.StructType(
        [T.StructField(f"_hk{i}", t) for i, t in enumerate(types)] + [T.StructField("_is", T.BooleanType())]))
    same = F.lit(True)
    for i, c in enumerate(ks):
        same = same & F.col(c).eqNullSafe(F.col(f"_hk{i}"))
    return df.join(F.broadcast(table), same, "left").select(*df.columns, F.col("_is").isNotNull().alias("_hot"))


def _window_cols(w, lag, lead, first, second, final: bool) -> list[Column]:
    p = "_" if final else "_w_"
    cols = [F.row_number().over(w).cast("bigint").alias(f"{p}rn")]
    cols += [F.lag(c).over(w).alias(f"{p}prev_{c}") for c in lag]
    cols += [F.lead(c).over(w).alias(f"{p}next_{c}") for c in lead]
    cols += [F.first(c).over(w).alias(f"{p}first_{c}") for c in first]
    cols += [F.nth_value(c, 2).over(w).alias(f"{p}second_{c}") for c in second]
    cols.append(F.lead(F.lit(1)).over(w).isNull().alias("_is_last" if final else "_w_last"))
    return cols
