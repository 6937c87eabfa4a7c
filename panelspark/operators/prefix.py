"""Skew-safe running aggregates over an entity's earlier rows.

A plain ``Window.partitionBy(entity).orderBy(date)`` puts every row of an
entity into one task; one entity holding a third of the data would then run
on a single core.  Here the work is split in two levels:

1. totals per (entity, date) are pre-aggregated map-side before their shuffle,
   so only one small row per (entity, date) and task moves;
2. a running sum over those per-date totals is a window per entity whose size
   is bounded by the number of calendar dates of that entity, not its rows;
3. ties on the same date are ranked by a window on (entity, date) and the two
   parts are added after an equi-join on (entity, date) that reuses the
   partitioning of step 1 (no second shuffle of the rows).

Where one (entity, date) may itself be large, the date is followed by finer
levels (an hour, a block of ids): totals are kept per finest level, each level
gets its running sum inside the level above, and no window holds more rows
than one finest level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _plus(a, b):
    """Sum of two parts; null only when both are (a sum over no non-null value is null, like pandas' expanding sum)."""
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def _offsets(totals: DataFrame, keys: list, levels: list, names: list) -> DataFrame:
    """Per (key, levels): the sums ``names`` over all earlier levels of the key, from the totals per finest level."""
    above, level = keys + levels[:-1], levels[-1]
    w = Window.partitionBy(*above).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    own = totals.select(*above, level, *[F.sum(n).over(w).alias(n) for n in names])
    if len(levels) == 1:
        return own
    coarser = _offsets(totals.groupBy(*above).agg(*[F.sum(n).alias(n) for n in names]), keys, levels[:-1], names)
    coarser = coarser.withColumnsRenamed({n: f"{n}_above" for n in names})
    return own.join(coarser, above, "left").select(
        *above, level, *[_plus(F.col(f"{n}_above"), F.col(n)).alias(n) for n in names])


def exclusive_running(df: DataFrame, key, coarse: str | list, order: list, values: dict,
                      counts: bool = True) -> DataFrame:
    """Add, for every row, sums (and non-null counts) of ``values`` over the rows
    of the same ``key`` that come strictly before it in (``coarse``, *order*).

    ``coarse`` must be a column of ``df`` that is monotone in the first order
    column (typically the date of a timestamp, or the date itself), or a list of
    such columns from coarse to fine, none of them null. The largest window is one
    finest level of one key.
    ``values`` maps an output prefix to a column name; outputs are
    ``<prefix>_sum`` and, with ``counts``, ``<prefix>_cnt`` (0 when no earlier row).
    Null keys never match the per-date totals (left join), so such rows keep
    only their same-date part; a DQ rule reports null keys as an error.
    """
    keys, levels = _keys(key), _keys(coarse)
    part = keys + levels
    measures = {f"__{kind}_{name}": agg(c) for name, c in values.items()
                for kind, agg in [("s", F.sum)] + [("n", F.count)] * counts}
    # partial aggregation runs before the shuffle: one small row per (key, levels) per task
    totals = df.groupBy(*part).agg(*[m.alias(f"{n}_before") for n, m in measures.items()])
    before = _offsets(totals, keys, levels, [f"{n}_before" for n in measures]).repartition(*[F.col(c) for c in part])

    w_ties = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.repartition(*[F.col(c) for c in part]).withColumns({n: m.over(w_ties) for n, m in measures.items()})
    out = rows.join(before, part, "left")
    result = {}
    for name in values:
        result[f"{name}_sum"] = _plus(F.col(f"__s_{name}_before"), F.col(f"__s_{name}"))
        if counts:
            result[f"{name}_cnt"] = F.coalesce(F.col(f"__n_{name}_before"), F.lit(0)) + F.coalesce(F.col(f"__n_{name}"), F.lit(0))
    return out.withColumns(result).drop(*measures, *[f"{n}_before" for n in measures])


def next_on_calendar(df: DataFrame, key, date_col: str, order: list, out: str) -> DataFrame:
    """``lead(date_col)`` per ``key`` in (date, *order) order, skew-safe.

    The next row is on the same date unless the row is the last of its date;
    then it is the first later date of the entity, found on the distinct
    (entity, date) table (bounded by the calendar).
    """
    keys = _keys(key)
    part = keys + [date_col]
    rows = df.repartition(*[F.col(c) for c in part])
    w_last = Window.partitionBy(*part).orderBy(*order).rowsBetween(1, 1)
    rows = rows.withColumn("__has_next_same", F.count(F.lit(1)).over(w_last) > 0)
    dates = df.select(*part).distinct()  # de-duplicated map-side before the shuffle
    w_next = Window.partitionBy(*keys).orderBy(date_col)
    nxt = dates.select(*part, F.lead(date_col).over(w_next).alias("__next_date")) \
        .repartition(*[F.col(c) for c in part])
    res = rows.join(nxt, part, "left")
    return res.withColumn(out, F.when(F.col("__has_next_same"), F.col(date_col))
                          .otherwise(F.col("__next_date"))).drop("__has_next_same", "__next_date")
