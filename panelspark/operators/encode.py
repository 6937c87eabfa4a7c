"""PRJ10-PRJ13: categorical encodings and their reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import in_vocab
from ..spec import DEFAULT, MULTILABEL_PATTERN, PanelSpec, onehot_names


def onehot(df: DataFrame, column: str, values) -> DataFrame:
    """PRJ10: exact, case-sensitive match; unknown or null -> all zeros (never null)."""
    names = onehot_names(column, values)
    return df.withColumns({n: F.col(column).eqNullSafe(F.lit(v)).cast("int")
                           for n, v in zip(names, values)})


def ordinal(df: DataFrame, column: str, levels, out: str | None = None) -> DataFrame:
    """PRJ11: level -> position; unknown or null -> null (DQ10 turns that into an error)."""
    expr = None
    for i, lv in enumerate(levels):
        expr = (F.when(F.col(column) == lv, F.lit(i)) if expr is None
                else expr.when(F.col(column) == lv, F.lit(i)))
    return df.withColumn(out or f"{column}_encoded", expr.cast("int"))


def encode_categories(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """All encodings of the spec; episode-constant, so run it before the explode."""
    for column, levels in spec.ordinal:
        df = ordinal(df, column, levels, spec.ordinal_column(column))
    for column, values in spec.onehot:
        df = onehot(df, column, values)
    return df


def unexpected_categories(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """PRJ12: values outside each vocabulary (null included) with their row counts."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(column).alias("column_name"), F.col(column).cast("string").alias("value"),
                 in_vocab(column, vocab).alias("known"))
        for column, vocab in list(spec.ordinal) + list(spec.onehot)]))
    return df.select(cells.alias("v")).select("v.*").filter(~F.col("known")) \
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def multilabel_values(df: DataFrame, columns=("diet", "symptoms"),
                      pattern: str = MULTILABEL_PATTERN) -> DataFrame:
    """PRJ13: rows per column whose value looks multi-label (null never matches)."""
    aggs = [F.sum(F.coalesce(F.col(c).rlike(pattern), F.lit(False)).cast("long")).alias(c)
            for c in columns]
    return df.agg(*aggs).unpivot([], list(columns), "column_name", "n_multilabel")


def onehot_row_sums(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """DQ9: per one-hot family, rows whose indicator sum is not exactly 1."""
    aggs = []
    for column, values in spec.onehot:
        s = reduce(lambda a, b: a + b, [F.col(n) for n in onehot_names(column, values)])
        aggs.append(F.sum((s != 1).cast("long")).alias(column))
    fam = [c for c, _ in spec.onehot]
    return df.agg(*aggs).unpivot([], fam, "family", "n_rows_sum_not_1")
