"""PRJ1-PRJ6, SRT1: names, dates, date-derived lengths, sink ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import DEFAULT, REQUIRED_COLUMNS, PanelSpec, snake

DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "dd.MM.yyyy",
                "yyyyMMdd", "MMM d, yyyy")


def normalize_column_names(df: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    """PRJ1: snake-case all headers (metadata only), raise on collisions or missing columns."""
    names = [snake(c) for c in df.columns]
    dupes = sorted({n for n in names if names.count(n) > 1})
    if dupes:
        raise ValueError(f"column names collide after normalisation: {dupes}")
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"required columns missing after normalisation: {missing}")
    return df.toDF(*names)


def parse_date(c, formats=DATE_FORMATS):
    """Lenient date parse: ISO forms (also with a time part) by cast, else the first format that fits, else
    null (never raises under ANSI)."""
    src = F.col(c) if isinstance(c, str) else c
    s = F.trim(src.cast("string"))
    iso = F.when(F.rlike(s, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}")), s.try_cast("date"))
    return F.coalesce(iso, *[F.to_date(F.try_to_timestamp(s, F.lit(f))) for f in formats])


def parse_dates(df: DataFrame, spec: PanelSpec = DEFAULT, formats=DATE_FORMATS) -> DataFrame:
    """PRJ2: both episode dates to DateType (time part dropped), bad values -> null."""
    return df.withColumns({c: parse_date(c, formats) for c in (spec.start, spec.next_start)})


def parse_failures(raw: DataFrame, spec: PanelSpec = DEFAULT, formats=DATE_FORMATS) -> DataFrame:
    """PRJ3: per date column, values present in the input that failed to parse."""
    aggs = []
    for c in (spec.start, spec.next_start):
        p = parse_date(c, formats)
        aggs.append(F.sum((F.col(c).isNotNull() & p.isNull()).cast("long")).alias(c))
    wide = raw.agg(*aggs)
    return wide.unpivot([], [spec.start, spec.next_start], "column_name", "n_failed")


def drop_bad_dates(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """PRJ4: rows without both dates cannot be expanded."""
    return df.dropna(subset=[spec.start, spec.next_start])


def date_length(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """PRJ5: length from the dates and its difference to the stated length."""
    computed = F.datediff(spec.next_start, spec.start)
    return df.withColumns({
        "computed_cycle_length": computed,
        "cycle_length_difference": computed - F.col(spec.length),
    })


def length_mismatch(df: DataFrame, spec: PanelSpec = DEFAULT, n: int | None = None) -> DataFrame:
    """PRJ6 / DQ11: rows whose stated length disagrees with the dates (optionally the first n)."""
    out = date_length(df, spec).filter(F.col("cycle_length_difference") != 0).select(
        spec.entity, spec.start, spec.next_start, spec.length, "computed_cycle_length",
        "cycle_length_difference")
    if n is not None:
        out = out.orderBy(spec.entity, spec.start).limit(n)
    return out


def calendar_parts(df: DataFrame, c: str, prefix: str = "cycle") -> DataFrame:
    """PRJ18: year, month and year-month of a date."""
    return df.withColumns({
        f"{prefix}_year": F.year(c),
        f"{prefix}_month": F.month(c),
        f"{prefix}_year_month": F.date_format(c, "yyyy-MM"),
    })


def cyclical_month(df: DataFrame, c: str) -> DataFrame:
    """PRJ22: month on the unit circle."""
    angle = F.lit(2.0 * 3.141592653589793) * F.month(c) / F.lit(12.0)
    return df.withColumns({"month_sin": F.sin(angle), "month_cos": F.cos(angle)})


def sort_for_sink(df: DataFrame, spec: PanelSpec = DEFAULT, extra=()) -> DataFrame:
    """SRT1: range-partition on (entity, start) and sort inside partitions.

    Range bounds come from a sample, so one large entity spreads over several
    partitions; files come out ordered without a single-task global sort.
    """
    keys = [spec.entity, spec.start, *extra]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)
