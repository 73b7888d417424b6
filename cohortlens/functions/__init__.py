"""Column-expression helpers: every one returns a built-in Spark ``Column``
(no Python UDFs), so they stay inside whole-stage codegen."""

from cohortlens.functions.exprs import (  # noqa: F401
    age_bracket,
    as_date,
    days_between,
    first_in_order,
    income_rank,
    money_sum,
    quantile,
    ratio,
    round_half_up,
)
