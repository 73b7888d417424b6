"""Quality rules by robust multivariate outliers (operator 6), native.

Text statistics are computed inside each row with array functions.  Rows that
pass the base rules are then judged against the minimum-covariance-determinant
estimate of their language and source: from a median/MAD start, concentration
steps keep the ``h`` fraction of rows with the least Mahalanobis distance and
take mean and covariance of these again.  Distances are ranked by a histogram
per group and statistics are held in fixed point with exact sums, so each step
is two pre-aggregated group-bys over a narrow table and gives the same result
on every run.  A row whose squared distance exceeds the chi-squared quantile
is an outlier.  Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
STATS = ("word_length", "symbols", "dup_lines", "repeats", "capitals", "length")
#: Units of a transformed statistic in fixed point.
UNIT = 64
#: Standard deviation added to each transformed statistic against a zero
#: variance: about two units where the estimate is to set the scale.  Repeated
#: lines and words are zero in most clean rows, so their estimate has no scale
#: of its own and one repeated line would reject a text; the length's floor
#: keeps a group full of copies from rejecting every text of another length.
FLOOR = (0.03, 0.03, 0.15, 0.15, 0.03, 0.75)
#: Groups below this many rows are estimated together.
LEAST_ROWS = 120
STEPS = 8
#: Broadcast bound for the table of group estimates (27 doubles a group).
BROADCAST_GROUPS = 20_000
DIM = len(STATS)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words that lie in an 8-word window found twice or more."""
    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(let(ordered, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"])),
            lambda x: x["i"]))), covered)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)),
                           lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW))))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(
        let(let(F.transform(words, lambda w: F.xxhash64(w)), windows),
            lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long"))
            .otherwise(repeated(hs))))


def text_statistics(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with its counts; a NULL text has none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.to_json(F.struct(F.col("lang").cast("string").alias("lang"),
                                           F.col("source").cast("string").alias("source"))).alias("grp"),
                        text.alias("text"))
            .select("doc_id", "grp",
                    let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"))).alias("w"),
                    let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                                  (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
                    F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
                    (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                    F.length(F.regexp_replace("text", "[^\\p{Lu}]+", "")).cast("long").alias("n_capitals"))
            .select("doc_id", "grp", F.col("w.n").alias("n_words"), "word_chars", "n_symbols",
                    F.col("l.dup").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"),
                    F.col("l.n").alias("n_lines"), "n_capitals")
            .withColumn("base_failed", (F.col("n_words") < 20)
                        | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))))


def _share(part: str, whole: str) -> Column:
    return F.asin(F.sqrt(F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0)))))


def _vector() -> dict[str, Column]:
    """The transformed statistics in fixed point."""
    values = (F.log(F.greatest(F.lit(1.0), F.coalesce(F.try_divide(F.col("word_chars"), F.col("n_words")), F.lit(1.0)))),
              _share("n_symbols", "word_chars"), _share("n_dup_lines", "n_lines"),
              _share("n_repeat_words", "n_words"), _share("n_capitals", "word_chars"),
              F.log(F.col("n_words") + 1.0))
    return {f"x{k}": F.round(v * UNIT).cast("long") for k, v in enumerate(values)}


def chi2_quantile(p: float, k: int) -> float:
    """Chi-squared quantile by the Wilson-Hilferty approximation."""
    z = NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3


def chi2_cdf(x: float, k: int) -> float:
    return NormalDist().cdf(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def _cholesky(params: DataFrame) -> DataFrame:
    """Adds the factor ``l{i}{j}`` of the covariances ``c{i}{j}``.  Every
    variance has its floor added, so the matrix is positive definite."""
    for i in range(DIM):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j
                                       else rest / F.col(f"l{j}{j}"))
    return params.select("grp", *[f"m{i}" for i in range(DIM)], *[f"l{i}{j}" for i in range(DIM) for j in range(i + 1)])


def _distances(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance by forward substitution."""
    small = params.count() <= BROADCAST_GROUPS
    out = rows.join(F.broadcast(params) if small else params, "grp")
    for i in range(DIM):
        rest = F.col(f"x{i}") / F.lit(float(UNIT)) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return out.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, DIM)), F.col("y0") * F.col("y0")))


def _start(rows: DataFrame) -> DataFrame:
    """Median and MAD of each statistic; fixed point bounds the number of
    distinct values that an exact percentile holds."""
    medians = staged(rows.groupBy("grp").agg(*[F.percentile(f"x{i}", F.lit(0.5)).alias(f"p{i}") for i in range(DIM)]), "medians")
    off = rows.join(F.broadcast(medians) if medians.count() <= BROADCAST_GROUPS else medians, "grp")
    off = off.groupBy("grp").agg(*[F.first(f"p{i}").alias(f"p{i}") for i in range(DIM)],
                                 *[F.percentile(F.abs(F.col(f"x{i}") - F.col(f"p{i}")), F.lit(0.5)).alias(f"a{i}")
                                   for i in range(DIM)])
    scale = [F.col(f"a{i}") * (1.4826 / UNIT) for i in range(DIM)]
    return off.select("grp", *[(F.col(f"p{i}") / UNIT).alias(f"m{i}") for i in range(DIM)],
                      *[(scale[i] * scale[i] + FLOOR[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}")
                        for i in range(DIM) for j in range(i + 1)])


def _concentrate(rows: DataFrame, params: DataFrame, share: float) -> DataFrame:
    """One concentration step: moments of the nearest ``share`` of each group.
    Distances are ranked by bins of 1/64 of a doubling."""
    near = _distances(rows, params).select(
        "grp", *[f"x{i}" for i in range(DIM)], F.floor(64 * F.log2(F.col("d2") + 1e-6)).alias("bin"))
    counts = near.groupBy("grp", "bin").agg(F.count("*").alias("n"))
    ranked = counts.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"),
                                       F.sum("n").alias("total"))
    # the first bin at which the running count reaches the share
    cut = ranked.select("grp", F.aggregate(
        "bins", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("cut")),
        lambda a, b: F.struct((a["seen"] + b["n"]).alias("seen"),
                              F.coalesce(a["cut"], F.when(a["seen"] + b["n"] >= share * F.col("total"), b["bin"])).alias("cut")),
        lambda a: a["cut"]).alias("cut"))
    cut = staged(cut, "cuts")
    kept = near.join(F.broadcast(cut) if cut.count() <= BROADCAST_GROUPS else cut, "grp").where(F.col("bin") <= F.col("cut"))
    exact = lambda c: F.sum(c.cast("decimal(20,0)")).cast("double")
    moments = kept.groupBy("grp").agg(
        F.count("*").cast("double").alias("n"), *[exact(F.col(f"x{i}")).alias(f"s{i}") for i in range(DIM)],
        *[exact(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(DIM) for j in range(i + 1)])
    # consistency factor of a covariance taken from the central share
    factor = share / chi2_cdf(chi2_quantile(share, DIM), DIM + 2)
    out = moments.select("grp", *[(F.col(f"s{i}") / F.col("n") / UNIT).alias(f"m{i}") for i in range(DIM)], *[
        (((F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")) / F.col("n")) * (factor / UNIT ** 2)
         + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in range(DIM) for j in range(i + 1)])
    return staged(_cholesky(out), "estimates")


def quality_rules(docs: DataFrame, share: float = 0.75, tail: float = 1e-6) -> DataFrame:
    """Counts and verdict of every row of ``docs``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, distance``; ``distance`` (squared
    Mahalanobis) is NULL where the base rules fail.  NULL and empty texts fail
    the base rules.  NULL languages and sources are values of their own.
    Groups of fewer than ``LEAST_ROWS`` rows that pass the base rules are
    estimated together; if even these are fewer, their rows are kept.
    Repeated rows are judged alike; an empty table gives an empty result.
    """
    stats = staged(text_statistics(docs), "statistics").withColumns(_vector())
    passed = stats.where(~F.col("base_failed"))
    sizes = staged(passed.groupBy("grp").agg(F.count("*").alias("rows")), "sizes")
    few = sizes.count() <= BROADCAST_GROUPS
    narrow = passed.select("grp", *[f"x{i}" for i in range(DIM)])
    named = F.when(F.col("rows") >= LEAST_ROWS, F.col("grp")).otherwise(F.lit("")).alias("grp")
    sized = lambda df: df.join(F.broadcast(sizes) if few else sizes, "grp", "left")
    rows = staged(sized(narrow).select(named, *[f"x{i}" for i in range(DIM)]), "vectors")
    params = staged(_cholesky(_start(rows)), "estimates")
    for _ in range(STEPS):
        params = _concentrate(rows, params, share)
    judged = sized(stats).select(*[c for c in stats.columns if c != "grp"], named)
    enough = rows.groupBy("grp").agg(F.count("*").alias("rows")).where(F.col("rows") >= LEAST_ROWS).select("grp")
    params = staged(params.join(enough, "grp", "left_semi"), "estimates")
    known = _distances(judged.where(~F.col("base_failed")), params)
    wide = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    cut = chi2_quantile(1 - tail, DIM)
    out = known.select(*wide, (F.col("d2") <= cut).alias("kept"), F.col("d2").alias("distance"))
    plain = judged.where(~F.col("base_failed")).join(
        F.broadcast(params.select("grp")) if few else params.select("grp"), "grp", "left_anti")
    return (out.unionByName(plain.select(*wide, F.lit(True).alias("kept"), F.lit(None).cast("double").alias("distance")))
            .unionByName(judged.where("base_failed").select(*wide, F.lit(False).alias("kept"),
                                                            F.lit(None).cast("double").alias("distance"))))
