"""GEN1, PRJ7-PRJ9: one row per day of every episode, with both targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import DEFAULT, PanelSpec


def phase_label(day, length, prefix, offset: int = 14) -> Column:
    """PRJ7: first matching rule wins; day is 0-based."""
    d, n, p = (F.col(x) if isinstance(x, str) else x for x in (day, length, prefix))
    ovu = n - F.lit(offset)
    return (F.when(d < p, 0).when(d < ovu, 1).when(d == ovu, 2).otherwise(3)).cast("int")


def phase_name(label, names) -> Column:
    lab = F.col(label) if isinstance(label, str) else label
    expr = F.when(lab == 0, names[0])
    for i, n in enumerate(names[1:], start=1):
        expr = expr.when(lab == i, n)
    return expr


def day_sequence(length) -> Column:
    """0 .. length-1 as integers, whatever integer type the length has; a length that isn't
    positive, or doesn't fit an integer, fails the job (DQ1), never drops rows."""
    n = F.col(length) if isinstance(length, str) else length
    return F.when((n >= 1) & (n <= 2**31 - 1), F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(
        F.raise_error(F.concat(F.lit("episode length must be positive and fit an integer, got "),
                               F.coalesce(n.cast("string"), F.lit("null")))))


def expand_days(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """GEN1 + PRJ7-9: explode episodes into days; all episode columns are kept.

    Row-local (``Generate`` inside whole-stage codegen): the daily panel keeps
    the partitioning of the episode table, so no shuffle follows the explode.
    """
    day = F.col(spec.day)
    out = df.withColumn(spec.day, F.explode(day_sequence(spec.length)))
    sample = F.date_add(F.col(spec.start), day)
    out = out.withColumns({
        spec.sample_date: sample,
        spec.countdown: F.datediff(F.col(spec.next_start), sample),
        spec.label: phase_label(day, spec.length, spec.prefix, spec.ovulation_offset),
    })
    return out.withColumn(spec.label_name, phase_name(spec.label, spec.phase_names))
