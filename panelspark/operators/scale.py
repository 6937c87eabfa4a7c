"""SCL1-SCL3: min-max scaling fitted on train rows only, no clipping.

Fitted parameters are one row (two numbers per column), broadcast to every
row; a constant train column gets divisor 1, so it maps to 0 (not 0.5 as
``pyspark.ml.feature.MinMaxScaler`` would).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import DEFAULT, PanelSpec


def fit_minmax(df: DataFrame, columns=None, spec: PanelSpec = DEFAULT,
               fit_filter=None) -> DataFrame:
    """SCL1: one row with ``<c>__min``, ``<c>__max``, ``<c>__scale``, ``<c>__offset``."""
    columns = list(columns or spec.scale_columns)
    missing = [c for c in columns if c not in df.columns]
    if missing:  # DQ19
        raise ValueError(f"scale columns missing: {missing}")
    src = df if fit_filter is None else df.filter(fit_filter)
    mm = src.agg(*[a for c in columns for a in (F.min(F.col(c).cast("double")).alias(f"{c}__min"),
                                                F.max(F.col(c).cast("double")).alias(f"{c}__max"))])
    out = []
    for c in columns:
        rng = F.col(f"{c}__max") - F.col(f"{c}__min")
        scale = F.lit(1.0) / F.when(rng == 0, F.lit(1.0)).otherwise(rng)
        out += [F.col(f"{c}__min"), F.col(f"{c}__max"), scale.alias(f"{c}__scale")]
    p = mm.select(*out)
    return p.select("*", *[(F.lit(0.0) - F.col(f"{c}__min") * F.col(f"{c}__scale"))
                           .alias(f"{c}__offset") for c in columns])


def params_long(params: DataFrame, columns=None, spec: PanelSpec = DEFAULT) -> DataFrame:
    """The fitted parameters as (column_name, data_min, data_max, scale, min_offset) rows."""
    columns = list(columns or spec.scale_columns)
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                           F.col(f"{c}__min").alias("data_min"),
                                           F.col(f"{c}__max").alias("data_max"),
                                           F.col(f"{c}__scale").alias("scale"),
                                           F.col(f"{c}__offset").alias("min_offset"))
                                  for c in columns]))
    return params.select(stacked.alias("p")).select("p.*")


def apply_minmax(df: DataFrame, params: DataFrame, columns=None, spec: PanelSpec = DEFAULT,
                 keep_raw: tuple = ()) -> DataFrame:
    """SCL2 / JN3: ``x * scale + offset`` against the broadcast one-row parameters.
    Columns in ``keep_raw`` are also kept unscaled as ``<c>_raw`` (T14: order by raw day)."""
    columns = list(columns or spec.scale_columns)
    j = df.withColumns({f"{c}_raw": F.col(c) for c in keep_raw}).crossJoin(F.broadcast(params))
    j = j.withColumns({c: F.col(c).cast("double") * F.col(f"{c}__scale") + F.col(f"{c}__offset")
                       for c in columns})
    return j.drop(*params.columns)


def inverse_minmax(df: DataFrame, params: DataFrame, columns=None, spec: PanelSpec = DEFAULT) -> DataFrame:
    """SCL3: back to the original units."""
    columns = list(columns or spec.scale_columns)
    j = df.crossJoin(F.broadcast(params))
    j = j.withColumns({c: (F.col(c) - F.col(f"{c}__offset")) / F.col(f"{c}__scale") for c in columns})
    return j.drop(*params.columns)


def _total(exprs):
    out = F.lit(0).cast("long")
    for e in exprs:
        out = out + e
    return out


def range_counts(df_columns, columns=None, spec: PanelSpec = DEFAULT, tol: float = 1e-9, targets=None) -> dict:
    """DQ12-DQ14 as row-local counts by name: out-of-range scaled cells (train with tolerance, others
    strict), null scaled cells, null targets, indicator cells outside {0, 1}."""
    columns = list(columns or spec.scale_columns)
    targets = list(targets or [spec.countdown, spec.label])
    is_train = F.col("split") == "train"
    lo = F.when(is_train, F.lit(-tol)).otherwise(F.lit(0.0))
    hi = F.when(is_train, F.lit(1.0 + tol)).otherwise(F.lit(1.0))
    return {
        "n_out_of_range": _total([F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False)).cast("long") for c in columns]),
        "n_null_scaled": _total([F.col(c).isNull().cast("long") for c in columns]),
        "n_null_target": _total([F.col(c).isNull().cast("long") for c in targets if c in df_columns]),
        "n_non_binary": _total([(~F.coalesce(F.col(c).isin(0, 1), F.lit(False))).cast("long")
                                for c in spec.indicator_columns if c in df_columns]),
    }


def range_report(df: DataFrame, columns=None, spec: PanelSpec = DEFAULT, tol: float = 1e-9,
                 targets=None) -> DataFrame:
    """DQ12-DQ14 per split."""
    counts = range_counts(df.columns, columns, spec, tol, targets)
    return df.groupBy("split").agg(*[F.sum(e).alias(n) for n, e in counts.items()])
