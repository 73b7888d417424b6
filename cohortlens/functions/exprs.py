"""Column expressions shared by the operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.config import AGE_BRACKETS, AGE_TOP_BRACKET, INCOME_BRACKET_ORDER


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(d: dt.date | str) -> Column:
    """A typed DATE literal (constant-folded by Catalyst)."""
    return F.lit(d if isinstance(d, dt.date) else dt.date.fromisoformat(d))


def days_between(later, earlier) -> Column:
    """``DATE_DIFF(later, earlier, DAY)``: whole days, NULL if either is NULL."""
    return F.datediff(_col(later), _col(earlier))


#: Scale of exact sums: keeps the digits of the input.
EXACT = "decimal(38,12)"


def money_sum(c) -> Column:
    """Sum of a money column in DECIMAL: independent of row order, and no digit
    of the input is dropped before the sum."""
    return F.sum(_col(c).cast(EXACT))


def ratio(num, den) -> Column:
    """``SAFE_DIVIDE``: NULL when the denominator is 0 or NULL."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def round_half_up(c, scale: int) -> Column:
    """``ROUND(x, n)`` half away from zero on the decimal value of ``x``."""
    return F.round(_col(c).cast("decimal(38,12)"), scale).cast("double")


def quantile(name: str, q: float, exact: bool = True, accuracy: int = 10000) -> Column:
    """Discrete quantile of column ``name``: the smallest value whose
    cumulative share reaches ``q``; NULLs skipped, all-NULL group gives NULL.

    ``exact`` uses ``percentile_disc`` (a value->count map per group, bounded
    by the number of distinct values, merged partially before the shuffle);
    otherwise the mergeable ``percentile_approx`` sketch.
    """
    if exact:
        return F.expr(f"percentile_disc({float(q)}) WITHIN GROUP (ORDER BY `{name}`)")
    return F.percentile_approx(F.col(name), q, accuracy)


def first_in_order(value, *order, where=None) -> Column:
    """Aggregate: ``value`` of the first row in ``order`` among rows where
    ``where`` holds and ``value`` is not NULL (``ARRAY_AGG(.. IGNORE NULLS
    ORDER BY .. LIMIT 1)[SAFE_OFFSET(0)]``). Built on ``min`` of a struct, so
    it combines partially before the shuffle."""
    v = _col(value)
    cond = v.isNotNull() if where is None else (where & v.isNotNull())
    keyed = F.struct(*[_col(o) for o in order], v.alias("v"))
    return F.min(F.when(cond, keyed)).getField("v")


def age_bracket(age) -> Column:
    """Eight-way age bracket; under 18 or NULL gives NULL."""
    a = _col(age)
    expr = None
    for label, lo, hi in AGE_BRACKETS:
        cond = a.between(lo, hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.when(a > AGE_BRACKETS[-1][2], AGE_TOP_BRACKET)


def income_rank(bracket) -> Column:
    """Sort position of an income bracket; unknown brackets give NULL."""
    b = _col(bracket)
    expr = None
    for i, label in enumerate(INCOME_BRACKET_ORDER, start=1):
        expr = F.when(b == label, i) if expr is None else expr.when(b == label, i)
    return expr
