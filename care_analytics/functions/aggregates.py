"""Aggregate expressions whose results do not depend on row order.

Money is summed as DECIMAL and durations as whole seconds, so a sum is the
same number whatever the partitioning, the number of executors or the order
of rows after a shuffle. A mean is one division of that exact sum by a count.
This keeps reports reproducible between runs and between engines, and costs
little: the partial (map-side) aggregate still runs before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from .columns import col_

# Six decimals hold any price x rate; the sum type is DECIMAL(38, 6), and a product with a row count keeps six
# decimals. ``audit_amounts`` counts what does not fit.
MONEY_PRECISION, MONEY_SCALE = 28, 6


def money(c: Column | str, precision: int = MONEY_PRECISION, scale: int = MONEY_SCALE) -> Column:
    """A double amount as exact DECIMAL; NULL when it has too many digits before the point (or is no number)."""
    return col_(c).try_cast(DecimalType(precision, scale))


def exact_sum(c: Column | str, precision: int = MONEY_PRECISION, scale: int = MONEY_SCALE) -> Column:
    """SUM of an amount, exact, as DECIMAL."""
    return F.sum(money(c, precision, scale))


def audit_amounts(df: DataFrame, *columns: str, precision: int = MONEY_PRECISION, scale: int = MONEY_SCALE) -> DataFrame:
    """A row for each amount column: ``amounts`` (not NULL), ``rounded`` (more decimals than ``scale``) and ``rejected`` (too large,
    or no number; sums leave them out). One pass, no shuffle but of a row for each task."""
    cells = []
    for c in columns:
        value, exact = F.col(c).cast("double"), money(c, precision, scale)
        cells += [F.count(value).alias(f"{c}__amounts"), F.count_if(exact.isNotNull() & (exact.cast("double") != value)).alias(f"{c}__rounded"),
                  F.count_if(value.isNotNull() & exact.isNull()).alias(f"{c}__rejected")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{n}").alias(n) for n in ("amounts", "rounded", "rejected")]) for c in columns])
    return df.agg(*cells).select(F.inline(rows))


def to_double(c: Column) -> Column:
    return c.cast("double")


def sum_double(c: Column | str) -> Column:
    """Exact SUM reported as DOUBLE (NULL when there is no value)."""
    return to_double(exact_sum(c))


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as DOUBLE; NULL when the denominator is 0."""
    return F.try_divide(to_double(numerator), to_double(denominator))


def mean_money(c: Column | str) -> Column:
    """AVG of an amount: exact sum over count of non-NULL values."""
    return ratio(exact_sum(c), F.count(col_(c)))


def mean_integral(c: Column | str, divisor: float | None = None) -> Column:
    """AVG of an integral column (ages, seconds); optional unit divisor."""
    c = col_(c)
    m = ratio(F.sum(c), F.count(c))
    return m / F.lit(float(divisor)) if divisor else m


def stddev_rounded(c: Column | str, digits: int = 6) -> Column:
    """Sample standard deviation rounded to ``digits`` places."""
    return F.round(F.stddev_samp(to_double(col_(c))), digits)
