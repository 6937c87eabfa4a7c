"""DQ1-DQ19 as report DataFrames ``(check, severity, violations)``.

Each report is one aggregation pass at its table level (episode, daily,
split); ``enforce`` is the only action and raises on error-level rows.
Predicates count as violated when false *or null* (pandas semantics).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import count_true, count_violations, in_vocab
from ..spec import DEFAULT, PanelSpec, onehot_names


class DataQualityError(ValueError):
    pass


Checks = list[tuple[str, str, Column]]  # name, severity, aggregate that counts the violations


class Watched:
    """Checks taken while their rows are written: the sums are observed in the write itself, so the rows are not read
    again. Put it right before the write (nothing that shuffles after it), where a task that runs again counts once."""

    def __init__(self, df: DataFrame, checks: Checks, **more: Column):
        self.checks, self._seen = checks, Observation()
        self.rows = df.observe(self._seen, *[F.coalesce(e, F.lit(0)).cast("long").alias(f"c{i}") for i, (_, _, e) in enumerate(checks)],
                               *[e.alias(f"m_{k}") for k, e in more.items()])

    def results(self) -> list[tuple[str, str, int]]:
        """(check, severity, violations); once the write is done."""
        return [(c, s, self._seen.get[f"c{i}"]) for i, (c, s, _) in enumerate(self.checks)]

    def measured(self, name: str):
        return self._seen.get[f"m_{name}"]


def enforce_results(rows: list[tuple[str, str, int]], level: str = "error") -> None:
    """Raise :class:`DataQualityError` if a check of ``level`` has violations."""
    bad = [f"{c}={v}" for c, s, v in rows if s == level and v > 0]
    if bad:
        raise DataQualityError("; ".join(bad))


def results_of(report: DataFrame) -> list[tuple[str, str, int]]:
    """The rows of a report; a report has one row per check."""
    return [(r["check"], r["severity"], r["violations"]) for r in report.collect()]


def _report(df: DataFrame, checks: list[tuple[str, str, object]]) -> DataFrame:
    """One aggregation for all checks, then one row per check."""
    wide = df.agg(*[F.coalesce(expr, F.lit(0)).cast("long").alias(name)
                    for name, _, expr in checks])
    sev = F.create_map(*[x for name, s, _ in checks for x in (F.lit(name), F.lit(s))])
    long = wide.unpivot([], [n for n, _, _ in checks], "check", "violations")
    return long.select("check", sev[F.col("check")].alias("severity"), "violations")


def episode_checks(spec: PanelSpec = DEFAULT) -> list:
    n, p = F.col(spec.length), F.col(spec.prefix)
    ovu = n - F.lit(spec.ovulation_offset)
    return [
        ("null_entity_key", "error", F.sum(F.col(spec.entity).isNull().cast("long"))),
        ("length_positive", "error", count_violations(n > 0)),
        ("prefix_positive", "error", count_violations(p > 0)),
        ("prefix_below_length", "error", count_violations(p < n)),
        ("next_after_start", "error", count_violations(F.col(spec.next_start) > F.col(spec.start))),
        ("phase_overlap", "warn", count_true(ovu <= p)),
        ("ovulation_outside_episode", "warn", count_true(ovu >= n)),
        ("length_date_mismatch", "info",
         count_true(F.datediff(spec.next_start, spec.start) != n)),
    ]


def encoding_checks(spec: PanelSpec = DEFAULT) -> list:
    out = []
    for column, levels in spec.ordinal:
        enc = F.col(spec.ordinal_column(column))
        out.append((f"{column}_ordinal_invalid", "error",
                    count_violations(enc.isin(list(range(len(levels)))))))
    for column, values in spec.onehot:
        s = reduce(lambda a, b: a + b, [F.col(c) for c in onehot_names(column, values)])
        out.append((f"{column}_onehot_sum_not_1", "warn", count_violations(s == 1)))
    return out


def episode_report(episodes: DataFrame, spec: PanelSpec = DEFAULT, encoded: bool = True) -> DataFrame:
    """DQ1, DQ3, DQ9, DQ10, DQ11 and null keys in one pass over the episode table."""
    checks = episode_checks(spec) + (encoding_checks(spec) if encoded else [])
    return _report(episodes, checks)


def duplicate_episodes(episodes: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """DQ2: (entity, start) keys held by more than one row, with their row counts."""
    return (episodes.groupBy(*spec.episode_keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") > 1))


def nonchronological_entities(episodes: DataFrame, arrival: str, spec: PanelSpec = DEFAULT,
                              bucket_width: int = 1 << 16) -> DataFrame:
    """DQ7 / WIN4: entities whose starts decrease somewhere in arrival order
    (ties allowed), with the number of decreasing adjacent steps.

    Skew-safe: arrival numbers are cut into buckets of ``bucket_width``; the
    adjacent comparison runs inside each (entity, bucket), and only the first
    and last start of every bucket meet in a per-entity window, whose size is
    the entity's number of buckets, not its rows.
    """
    b = F.floor(F.col(arrival) / F.lit(bucket_width)).alias("__b")
    rows = episodes.select(spec.entity, spec.start, arrival, b).repartition(spec.entity, "__b")
    w_in = Window.partitionBy(spec.entity, "__b").orderBy(arrival)
    rows = rows.withColumn("__down", F.lag(spec.start).over(w_in) > F.col(spec.start))
    per_b = rows.groupBy(spec.entity, "__b").agg(
        count_true(F.col("__down")).alias("__inner"),
        F.min_by(spec.start, arrival).alias("__first"), F.max_by(spec.start, arrival).alias("__last"))
    w_b = Window.partitionBy(spec.entity).orderBy("__b")
    per_b = per_b.withColumn("__edge", (F.lag("__last").over(w_b) > F.col("__first")).cast("long"))
    return (per_b.groupBy(spec.entity)
            .agg((F.sum("__inner") + F.coalesce(F.sum("__edge"), F.lit(0))).alias("n_inversions"))
            .filter(F.col("n_inversions") > 0))


def phase_rule_violations(episodes: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """DQ3 rows: episodes whose ovulation day is not strictly between prefix and length."""
    n, p = F.col(spec.length), F.col(spec.prefix)
    ovu = n - F.lit(spec.ovulation_offset)
    return episodes.filter(F.coalesce(ovu <= p, F.lit(False)) | F.coalesce(ovu >= n, F.lit(False))) \
        .select(spec.entity, spec.start, spec.length, spec.prefix, ovu.alias("ovulation_day"),
                F.when(ovu <= p, "phase_overlap").otherwise("ovulation_outside_episode").alias("rule"))


def daily_report(daily: DataFrame, episodes: DataFrame | int, spec: PanelSpec = DEFAULT) -> DataFrame:
    """DQ4-DQ6 in one pass over the daily panel: row total vs. the sum of lengths (of the episodes, or as a
    number), target/label domains, and per episode the day set exactly 0..length-1 with
    each sample date equal to start + day (so dates rise strictly with the day).

    Aggregation runs (episode, 64 days) -> episode -> total: the days of a group are
    the bits of one long, so a task holds, and a shuffle moves, a row or two per
    episode and not one per day. Grouping keys always start with (entity, start), the
    partitioning the panel inherits from the history step; a panel read from files is
    shuffled by episodes after the partial sums.  No DISTINCT (no Expand).
    """
    keys = spec.episode_keys
    day = F.col(spec.day)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(day, F.lit(64)).cast("int"))
    row_bad = {
        "countdown_negative": not_true_col(F.col(spec.countdown) >= 0),
        "label_domain": not_true_col(F.col(spec.label).isin(*spec.labels)),
        "label_name_domain": not_true_col(in_vocab(spec.label_name, spec.phase_names)),
        "history_null": (F.col(spec.hist_length).isNull() | F.col(spec.hist_prefix).isNull()).cast("long"),
        "date_off": not_true_col(F.col(spec.sample_date) == F.date_add(F.col(spec.start), F.col(spec.day))),
    }
    per_word = daily.groupBy(*keys, F.floor(day / F.lit(64)).alias("__word")).agg(
        F.count(F.lit(1)).alias("__c"), F.max(spec.length).alias("__len"), F.bit_or(bit).alias("__bits"),
        F.min(day).alias("__dmin"), F.max(day).alias("__dmax"), *[F.sum(v).alias(k) for k, v in row_bad.items()])
    per_ep = per_word.groupBy(*keys).agg(
        # a null day has no bit and counts as one day
        F.sum("__c").alias("__rows"), F.sum(F.coalesce(F.bit_count("__bits"), F.lit(1))).alias("__days"),
        F.min("__dmin").alias("__dmin"), F.max("__dmax").alias("__dmax"), F.max("__len").alias("__len"),
        *[F.sum(k).alias(k) for k in row_bad])
    day_set_ok = ((F.col("__rows") == F.col("__len")) & (F.col("__days") == F.col("__len"))
                  & (F.col("__dmin") == 0) & (F.col("__dmax") == F.col("__len") - 1))
    tot = per_ep.agg(
        F.sum("__rows").alias("n_daily"),
        F.sum(F.when(F.coalesce(day_set_ok, F.lit(False)), 0).otherwise(1)).cast("long").alias("day_set"),
        F.sum((F.col("date_off") > 0).cast("long")).alias("dates_inc"),
        *[F.sum(k).alias(k) for k in row_bad if k != "date_off"])
    if isinstance(episodes, int):
        one = tot.withColumn("n_expected", F.lit(episodes).cast("long"))
    else:
        one = tot.crossJoin(episodes.agg(F.sum(spec.length).cast("long").alias("n_expected")))  # two one-row frames
    checks = [("daily_rows_equal_length_sum", "error",
               F.abs(F.col("n_daily") - F.col("n_expected"))),
              ("countdown_negative", "error", F.col("countdown_negative")),
              ("label_domain", "error", F.col("label_domain")),
              ("label_name_domain", "error", F.col("label_name_domain")),
              ("history_null", "error", F.col("history_null")),
              ("episode_day_set", "error", F.col("day_set")),
              ("sample_date_increasing", "error", F.col("dates_inc"))]
    wide = one.select(*[F.coalesce(e, F.lit(0)).cast("long").alias(n) for n, _, e in checks])
    sev = F.create_map(*[x for n, s, _ in checks for x in (F.lit(n), F.lit(s))])
    return wide.unpivot([], [n for n, _, _ in checks], "check", "violations") \
        .select("check", sev[F.col("check")].alias("severity"), "violations")


def not_true_col(pred):
    return (~F.coalesce(pred, F.lit(False))).cast("long")


def history_flag_report(hist: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """DQ8: first episode of each entity is flagged cold start, later ones are not.

    ``n_prior`` (earlier rows) comes from the history step itself, so this is a
    row-local predicate and needs no ranking window.
    """
    return _report(hist, history_flag_checks(spec))


def history_flag_checks(spec: PanelSpec = DEFAULT) -> Checks:
    first = F.col("n_prior_episodes") == 0
    return [
        ("first_episode_not_flagged", "error", count_true(first & (F.col(spec.cold_flag) != 1))),
        ("later_episode_flagged", "error", count_true(~first & (F.col(spec.cold_flag) != 0))),
    ]


def window_report(w: DataFrame, seq_length: int, n_features: int, spec: PanelSpec = DEFAULT) -> DataFrame:
    """DQ16: window arrays (``X``, ``y_phase``, ``y_reg``): inner length L, feature
    width F, labels of the spec's phases, only finite values, and at least one window."""
    return _report(w, window_checks(seq_length, n_features, spec=spec))


def window_checks(seq_length: int, n_features: int, among: Column | None = None, spec: PanelSpec = DEFAULT) -> Checks:
    """The rules of :func:`window_report`, for the rows of ``among`` if given."""
    among = F.lit(True) if among is None else among
    L = F.lit(int(seq_length))
    bad_len = (F.size("X") != L) | (F.size("y_phase") != L) | (F.size("y_reg") != L)
    bad_width = F.exists("X", lambda r: F.size(r) != F.lit(int(n_features)))
    bad_label = F.size(F.array_except("y_phase", F.array(*[F.lit(k) for k in spec.labels]))) > 0  # a null is no label

    def non_finite(v):
        return v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))

    def holds_non_finite(values):
        # built-in searches of the whole array; array_contains is null if it finds none among values with a null
        low, high = F.array_min(values), F.array_max(values)  # NaN is the largest value
        found = (low == F.lit(float("-inf"))) | (high == F.lit(float("inf"))) | F.isnan(high)
        return (F.size(values) > 0) & F.coalesce(found | F.array_contains(values, F.lit(float("nan")).cast("float")), F.lit(True))

    # an X that is null or has a null row can't be flattened and is left to the lambda
    flat = F.flatten("X")
    bad_x = F.when(flat.isNull(), F.exists("X", lambda r: F.exists(r, non_finite))).otherwise(holds_non_finite(flat))
    bad_value = bad_x | F.when(F.col("y_reg").isNotNull(), holds_non_finite(F.col("y_reg")))
    n = F.count_if(among)
    return [
        ("window_count", "info", n),
        ("inner_length", "error", count_true(among & bad_len)),
        ("feature_width", "error", count_true(among & bad_width)),
        ("label_domain", "error", count_true(among & bad_label)),
        ("non_finite_value", "error", count_true(among & bad_value)),
        ("no_windows", "error", (n == 0).cast("long")),
    ]


def require_stage(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """DQ18: refuse to split/scale a panel whose categorical encodings are missing."""
    need = [spec.ordinal_column(c) for c, _ in spec.ordinal] + spec.onehot_columns
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise DataQualityError(f"panel is not encoded yet; missing {missing}")
    return df


def enforce(report: DataFrame, level: str = "error") -> DataFrame:
    """Raise :class:`DataQualityError` if a check of ``level`` has violations."""
    enforce_results(results_of(report), level)
    return report
