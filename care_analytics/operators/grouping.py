"""Grouped statistics, pivots, shares and top-k over result-sized data.

Every operator is one ``groupBy`` (partial aggregate, shuffle, final
aggregate) or one ``TakeOrderedAndProject``; none gathers rows on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import to_double

# Grand totals are summed exactly, whatever the number of groups.
EXACT = "decimal(38,6)"


def count_by(df: DataFrame, *keys: str, alias: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))


def stats_by(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column],
             order: bool = False) -> DataFrame:
    """``groupBy(keys).agg(...)`` with named aggregates; optional key order."""
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.orderBy(*keys) if order and keys else out


def pivot_table(df: DataFrame, rows: Sequence[str], column: str, agg: Column,
                values: Sequence[str], fill=None) -> DataFrame:
    """Rows x ``values`` of ``column``; one aggregate per cell.

    ``values`` is explicit, so Spark needs no extra job to find them and the
    output schema does not depend on the data. ``fill`` replaces empty cells.
    """
    out = df.groupBy(*rows).pivot(column, list(values)).agg(agg)
    if fill is not None:
        out = out.fillna(fill, subset=list(values))
    return out


def pivot_all(df: DataFrame, rows: Sequence[str], column: str, agg: Callable[[Column], Column],
              values: Sequence[str], others: str = "(other)", missing: str = "(missing)") -> DataFrame:
    """Rows x ``values`` of ``column``, plus ``others`` for every other value and ``missing`` for NULL, so
    that no row is left out whatever the data hold; the schema does not depend on the data. ``agg``
    builds a cell from its condition."""
    named = F.col(column).isin(*values)
    cells = [agg(F.col(column) == F.lit(v)).alias(v) for v in values]
    cells += [agg(F.col(column).isNotNull() & ~named).alias(others), agg(F.col(column).isNull()).alias(missing)]
    return df.groupBy(*rows).agg(*cells)


def box_statistics(df: DataFrame, value: str, weighted: bool = True,
                   id_col: str | None = None) -> DataFrame:
    """min, quartiles (linear interpolation) and max of ``value``.

    ``weighted=True`` counts every row. ``weighted=False`` first reduces to
    distinct values, as a box plot over a table of value counts does.
    ``percentile`` keeps a value -> frequency map per group, so memory is
    bounded by the number of distinct values (ages: about a hundred).
    """
    src = df.select(value) if weighted else df.select(value).distinct()
    v = to_double(F.col(value))
    return src.agg(
        F.min(v).alias("min"),
        F.percentile(v, 0.25).alias("q1"),
        F.percentile(v, 0.5).alias("median"),
        F.percentile(v, 0.75).alias("q3"),
        F.max(v).alias("max"),
    )


def share(df: DataFrame, value: str, out: str = "share_pct") -> DataFrame:
    """Percentage of the grand total per row.

    The grand total is a scalar subquery: computed once, no cross join and no
    single-partition window.
    """
    total = df.select(F.sum(F.col(value).cast(EXACT))).scalar()
    return df.withColumn(out, F.try_divide(to_double(F.col(value)) * F.lit(100.0), to_double(total)))


CANDIDATES = 100_000        # rows of the ranked side that a rank join broadcasts at most


def top_k_joined(ranked: DataFrame, meet: Callable[[DataFrame], DataFrame], best: Callable[[DataFrame], DataFrame], k: int,
                 order: Sequence[Column], factor: int = 4) -> DataFrame:
    """The ``k`` best rows of an inner join whose order comes from ``ranked`` alone, without joining all of it (an action).

    The best ``factor * k`` rows of ``ranked`` are joined (``meet``); a row beyond them comes after all of theirs, so when they
    leave ``k`` rows these hold the answer (``best`` takes it). Otherwise the candidates grow fourfold, and beyond
    ``CANDIDATES`` all of ``ranked`` is joined.
    """
    size = factor * k
    while size <= CANDIDATES:
        taken = top_k(ranked, size, order)
        rows = meet(taken)
        if rows.limit(k).count() >= k or taken.count() < size:
            return best(rows)
        size *= 4
    return best(meet(ranked))


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """First ``k`` rows in ``order`` (TakeOrderedAndProject: no global sort)."""
    return df.orderBy(*order).limit(k)
