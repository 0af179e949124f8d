"""Rounding rules as plain column expressions.

JavaScript ``Math.round`` rounds halves toward +infinity, which differs from
Spark ``round`` (half away from zero, decimal based).  The store's ``$round``
is half-to-even.  Both are written out so that every engine evaluating the
same expression gets the same bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def js_round(col: Column, digits: int = 0) -> Column:
    """``Math.round(x * 10^d) / 10^d`` = ``floor(x * 10^d + 0.5) / 10^d`` (DOUBLE)."""
    scale = float(10 ** digits)
    col = _c(col)
    return (F.floor(col * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).cast("double")


def half_even(col: Column, digits: int = 1) -> Column:
    """Half-to-even rounding done in exact decimals, returned as DOUBLE."""
    return F.bround(_c(col).cast("decimal(38,10)"), digits).cast("double")


def exact_sum(col: Column) -> Column:
    """Order-independent sum of a DOUBLE column (decimal accumulator).

    A double sum depends on the order rows reach the aggregate, which varies
    with partitioning; summing in DECIMAL(38,10) makes the result the same on
    any cluster layout.
    """
    return F.sum(_c(col).cast("decimal(38,10)")).cast("double")


def exact_avg(col: Column) -> Column:
    """Mean as ``exact_sum / count`` (DOUBLE), independent of row order."""
    return exact_sum(col) / F.count(_c(col)).cast("double")


def exact_sum_over(col, window) -> Column:
    """:func:`exact_sum` as a window aggregate."""
    return F.sum(_c(col).cast("decimal(38,10)")).over(window).cast("double")
