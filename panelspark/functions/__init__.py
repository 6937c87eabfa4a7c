"""Column-expression helpers shared by the operators (all JVM-side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c, digits: int = 2) -> Column:
    """Round like numpy (banker's rounding on the binary value): rint(x*10^d)/10^d.

    ``F.round`` rounds half-up and ``F.bround`` rounds the decimal text, both
    differ from numpy on values such as 29.125.
    """
    scale = float(10 ** digits)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale)


def not_true(pred: Column) -> Column:
    """True when ``pred`` is false *or null* (pandas counts null comparisons as failures)."""
    return ~F.coalesce(pred, F.lit(False))


def count_violations(pred: Column) -> Column:
    """Number of rows where ``pred`` does not hold (null counts as a violation)."""
    return F.sum(not_true(pred).cast("long"))


def count_true(pred: Column) -> Column:
    return F.sum(F.coalesce(pred, F.lit(False)).cast("long"))


def first_argmax(arr) -> Column:
    """0-based index of the first maximum of an array (numpy ``argmax`` tie rule)."""
    a = col(arr)
    return (F.array_position(a, F.array_max(a)) - F.lit(1)).cast("int")


def safe_div(num, den) -> Column:
    """num / den, 0 when the denominator is 0 or null (zero_division=0)."""
    return F.coalesce(F.try_divide(col(num), col(den)), F.lit(0.0))


def in_vocab(c, values) -> Column:
    """Exact match against a vocabulary; null is *not* in it (never null itself)."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def unpivot_columns(df, ids, names, variable="column", value="value"):
    """Long form of a wide one-row (or keyed) report."""
    return df.unpivot(ids, list(names), variable, value)
