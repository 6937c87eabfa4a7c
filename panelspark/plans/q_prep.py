"""Catalog part 2 - entry B: entity split, train-only scaling, sliding windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import scale, sequences, split
from ..sources.tables import EPISODES_SQL, episodes, with_views
from ..spec import DEFAULT as S
from ..spec import SPLIT_RATIOS, SPLIT_SEED
from .pipelines import prepared_episodes, split_and_scale, split_daily, split_episodes, window_source
from .q_builder import DAILY_SQL, HISTORY_SQL
from .registry import query

R_TRAIN, R_VAL, R_TEST = SPLIT_RATIOS

MEMBERSHIP_SQL = f"""
membership AS (
 SELECT user_id, CASE WHEN rk <= nt THEN 'train' WHEN rk <= nt + nv THEN 'val' ELSE 'test' END AS split, rk
 FROM (SELECT *, LEAST(CAST(round_even(n * {R_VAL!r}e0, 0) AS BIGINT), n - nt) AS nv
  FROM (SELECT *, LEAST(CAST(round_even(n * {R_TRAIN!r}e0, 0) AS BIGINT), n) AS nt
   FROM (SELECT user_id, row_number() OVER (ORDER BY md5('{SPLIT_SEED}:' || CAST(user_id AS VARCHAR)), user_id) AS rk,
          COUNT(*) OVER () AS n
         FROM (SELECT DISTINCT user_id FROM episodes) u) r) r2) r3)"""

DSPLIT_SQL = """
dsplit AS (SELECT d.*, m.split FROM daily d JOIN membership m ON d.user_id = m.user_id)"""


def _params_sql():
    mm = ", ".join(f"MIN(CAST({c} AS DOUBLE)) AS {c}__min, MAX(CAST({c} AS DOUBLE)) AS {c}__max"
                   for c in S.scale_columns)
    sc = ", ".join(f"{c}__min, {c}__max, 1.0e0 / (CASE WHEN {c}__max - {c}__min = 0 THEN 1.0e0 "
                   f"ELSE {c}__max - {c}__min END) AS {c}__scale" for c in S.scale_columns)
    off = ", ".join(f"0.0e0 - {c}__min * {c}__scale AS {c}__offset" for c in S.scale_columns)
    return (f"mm AS (SELECT {mm} FROM dsplit WHERE split = 'train'),\n"
            f"ps AS (SELECT {sc} FROM mm),\nparams AS (SELECT *, {off} FROM ps)")


SCALED_SQL = ("scaled AS (SELECT d.* REPLACE (" + ", ".join(
    f"CAST(d.{c} AS DOUBLE) * p.{c}__scale + p.{c}__offset AS {c}" for c in S.scale_columns)
    + "), d.day_in_cycle AS day_in_cycle_raw FROM dsplit d CROSS JOIN params p)")


def P(body: str, *more: str) -> str:
    """SQL over the split (``dsplit``) and scaled (``scaled``) daily panels."""
    return with_views(body, EPISODES_SQL, HISTORY_SQL, DAILY_SQL, MEMBERSHIP_SQL, DSPLIT_SQL,
                      _params_sql(), SCALED_SQL, *more)


def _prep(spark, sf):
    return split_and_scale(episodes(spark, sf))


def _windows_src(spark, sf, features=None):
    return window_source(episodes(spark, sf), features=features)


# --- split ----------------------------------------------------------------

@query("entity_split", P("SELECT user_id, split, rk AS rank FROM membership"))
def q_entity_split(spark, sf):
    return split.split_membership(episodes(spark, sf)).select("user_id", "split", "rank")


@query("split_overlap", P("""
SELECT pair, CAST(n AS BIGINT) AS n_entities FROM (
 SELECT 'train&val' AS pair, (SELECT COUNT(*) FROM (SELECT user_id FROM dsplit WHERE split = 'train'
   INTERSECT SELECT user_id FROM dsplit WHERE split = 'val')) AS n
 UNION ALL SELECT 'train&test', (SELECT COUNT(*) FROM (SELECT user_id FROM dsplit WHERE split = 'train'
   INTERSECT SELECT user_id FROM dsplit WHERE split = 'test'))
 UNION ALL SELECT 'val&test', (SELECT COUNT(*) FROM (SELECT user_id FROM dsplit WHERE split = 'val'
   INTERSECT SELECT user_id FROM dsplit WHERE split = 'test'))
 UNION ALL SELECT 'covered', (SELECT COUNT(DISTINCT user_id) FROM dsplit)) t"""))
def q_split_overlap(spark, sf):
    return split.split_overlap(split_daily(episodes(spark, sf)))


@query("split_summary", P(f"""
SELECT split, COUNT(DISTINCT user_id) AS n_entities,
 COUNT(DISTINCT (user_id, cycle_start_date)) AS n_episodes, COUNT(*) AS n_rows,
 MIN(days_until_next_cycle) AS countdown_min, MAX(days_until_next_cycle) AS countdown_max,
 {R_TRAIN!r}e0 AS train_ratio, {R_VAL!r}e0 AS val_ratio, {R_TEST!r}e0 AS test_ratio, {SPLIT_SEED} AS random_state
FROM dsplit GROUP BY split"""))
def q_split_summary(spark, sf):
    sp = split_daily(episodes(spark, sf))
    # (entity, start) is unique per episode, so distinct episodes = rows at day 0
    return sp.groupBy("split").agg(
        F.countDistinct("user_id").alias("n_entities"),
        F.sum((F.col("day_in_cycle") == 0).cast("long")).alias("n_episodes"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min("days_until_next_cycle").alias("countdown_min"),
        F.max("days_until_next_cycle").alias("countdown_max"),
        *split.split_params())


@query("phase_share_by_split", P("""
SELECT split, phase_label, COUNT(*) AS n_rows,
 COUNT(*) * 100.0e0 / SUM(COUNT(*)) OVER (PARTITION BY split) AS share_pct
FROM dsplit GROUP BY split, phase_label"""))
def q_phase_share_by_split(spark, sf):
    sp = split_daily(episodes(spark, sf))
    c = sp.groupBy("split", "phase_label").agg(F.count(F.lit(1)).alias("n_rows"))
    # at most (#splits x #labels) rows: the per-split total is a tiny window
    return c.withColumn("share_pct", F.col("n_rows") * F.lit(100.0)
                        / F.sum("n_rows").over(Window.partitionBy("split")))


# --- scaling --------------------------------------------------------------

@query("minmax_params", P("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {c}__min AS data_min, {c}__max AS data_max, {c}__scale AS scale, "
    f"{c}__offset AS min_offset FROM params" for c in S.scale_columns)))
def q_minmax_params(spark, sf):
    _, params = _prep(spark, sf)
    return scale.params_long(params)


@query("minmax_scaled", P("SELECT user_id, cycle_start_date, day_in_cycle_raw, split, "
                          + ", ".join(S.scale_columns) + " FROM scaled"))
def q_minmax_scaled(spark, sf):
    scaled, _ = _prep(spark, sf)
    return scaled.select("user_id", "cycle_start_date", "day_in_cycle_raw", "split", *S.scale_columns)


_IND = S.indicator_columns


def range_report_sql(panel: str) -> str:
    """DQ12-DQ14 of the scaled panel ``panel``."""
    return f"""
SELECT split,
 CAST(SUM({' + '.join(f"CAST(COALESCE({c} < lo OR {c} > hi, false) AS BIGINT)" for c in S.scale_columns)}) AS BIGINT) AS n_out_of_range,
 CAST(SUM({' + '.join(f"CAST({c} IS NULL AS BIGINT)" for c in S.scale_columns)}) AS BIGINT) AS n_null_scaled,
 CAST(SUM(CAST(days_until_next_cycle IS NULL AS BIGINT) + CAST(phase_label IS NULL AS BIGINT)) AS BIGINT)
  AS n_null_target,
 CAST(SUM({' + '.join(f"CAST(NOT COALESCE({c} IN (0, 1), false) AS BIGINT)" for c in _IND)}) AS BIGINT)
  AS n_non_binary
FROM (SELECT *, CASE WHEN split = 'train' THEN -1e-9 ELSE 0.0e0 END AS lo,
       CASE WHEN split = 'train' THEN 1.0e0 + 1e-9 ELSE 1.0e0 END AS hi FROM {panel}) s
GROUP BY split"""


@query("scaled_out_of_range", P(range_report_sql("scaled")))
def q_scaled_out_of_range(spark, sf):
    scaled, _ = _prep(spark, sf)
    return scale.range_report(scaled)


# --- windows ----------------------------------------------------------------

POS_SQL = """
pos AS (SELECT split, user_id, cycle_start_date, day_in_cycle, phase_label, days_until_next_cycle,
  row_number() OVER (PARTITION BY user_id, cycle_start_date ORDER BY day_in_cycle) - 1 AS p,
  COUNT(*) OVER (PARTITION BY user_id, cycle_start_date) AS n
 FROM dsplit)"""


def _digest_sql(L: int) -> str:
    return P(f"""
SELECT a.split, a.user_id, a.cycle_start_date, CAST({L} AS INT) AS seq_length, CAST(a.p AS INT) AS window_start,
 CAST(MIN(b.day_in_cycle) AS INT) AS first_day, CAST(MAX(b.day_in_cycle) AS INT) AS last_day,
 CAST(SUM(b.phase_label) AS BIGINT) AS sum_label, CAST(SUM(b.days_until_next_cycle) AS BIGINT) AS sum_countdown,
 md5(string_agg(CAST(b.phase_label AS VARCHAR), ',' ORDER BY b.p)) AS labels_md5
FROM pos a JOIN pos b ON a.user_id = b.user_id AND a.cycle_start_date = b.cycle_start_date
 AND b.p BETWEEN a.p AND a.p + {L - 1}
WHERE a.p <= a.n - {L}
GROUP BY a.split, a.user_id, a.cycle_start_date, a.p""", POS_SQL)


def _digest(spark, sf, L):
    # the digest needs day, label and countdown only: no feature vectors are built
    return sequences.window_digest_from_rows(_windows_src(spark, sf, features=[]), L)


@query("window_digest_14", _digest_sql(14))
def q_window_digest_14(spark, sf):
    return _digest(spark, sf, 14)


@query("window_digest_21", _digest_sql(21))
def q_window_digest_21(spark, sf):
    return _digest(spark, sf, 21)


def _sizes(spark, sf):
    """Rows per episode of the split panel, on the (entity, start) partitioning it inherits: no shuffle, no days."""
    ep = split_episodes(prepared_episodes(episodes(spark, sf)))
    return sequences.episode_sizes_direct(ep, ["user_id", "cycle_start_date", "split"])


EP_SQL = """
ep AS (SELECT split, user_id, cycle_start_date, COUNT(*) AS n FROM dsplit GROUP BY split, user_id, cycle_start_date)"""


@query("window_counts", P("""
SELECT split, CAST(seq_length AS INT) AS seq_length, COUNT(*) AS n_episodes,
 CAST(SUM(CASE WHEN n < seq_length THEN 1 ELSE 0 END) AS BIGINT) AS n_skipped,
 CAST(SUM(GREATEST(n - seq_length + 1, 0)) AS BIGINT) AS n_windows_expected,
 CAST(SUM(GREATEST(n - seq_length + 1, 0)) AS BIGINT) AS n_windows
FROM ep CROSS JOIN (SELECT * FROM (VALUES (14), (21), (40)) t(seq_length)) l
GROUP BY split, seq_length""", EP_SQL))
def q_window_counts(spark, sf):
    sizes = _sizes(spark, sf)
    return sequences.window_counts(sizes, [14, 21, 40], ["split"])


@query("skipped_episodes", P("""
SELECT split, user_id, cycle_start_date, CAST(n AS INT) AS n_rows, CAST(40 AS INT) AS seq_length
FROM ep WHERE n < 40""", EP_SQL))
def q_skipped_episodes(spark, sf):
    sizes = _sizes(spark, sf)
    return sizes.filter(F.col("__n") < 40).select(
        "split", "user_id", "cycle_start_date", F.col("__n").alias("n_rows"), F.lit(40).alias("seq_length"))


@query("window_target_stats", P("""
SELECT a.split, CAST(l.L AS INT) AS seq_length, COUNT(*) AS n_timesteps,
 CAST(MIN(b.days_until_next_cycle) AS DOUBLE) AS y_reg_min, CAST(MAX(b.days_until_next_cycle) AS DOUBLE) AS y_reg_max,
 round(AVG(b.days_until_next_cycle), 6) AS y_reg_mean, round(STDDEV_POP(b.days_until_next_cycle), 6) AS y_reg_std
FROM pos a CROSS JOIN (SELECT * FROM (VALUES (14), (21)) t(L)) l
 JOIN pos b ON a.user_id = b.user_id AND a.cycle_start_date = b.cycle_start_date AND b.p BETWEEN a.p AND a.p + l.L - 1
WHERE a.p <= a.n - l.L
GROUP BY a.split, l.L""", POS_SQL))
def q_window_target_stats(spark, sf):
    """AGG18 over the flattened windows, computed without materialising them: each
    daily row counts as often as the windows that contain it (GEN5 by weight)."""
    return window_target_stats(split_daily(episodes(spark, sf)), [14, 21])


def window_target_stats(sp, lengths, spec=S):
    per_l = sp.select("split", spec.day, spec.length, spec.countdown,
                      F.explode(F.array(*[F.lit(int(x)) for x in lengths])).alias("seq_length"))
    L = F.col("seq_length")
    hi = F.least(F.col(spec.day), F.col(spec.length) - L)
    lo = F.greatest(F.lit(0), F.col(spec.day) - L + 1)
    w = F.greatest(hi - lo + 1, F.lit(0)).cast("double")
    r = F.col(spec.countdown).cast("double")
    g = per_l.withColumn("__w", w).filter(F.col("__w") > 0).groupBy("split", "seq_length").agg(
        F.sum("__w").alias("sw"), F.sum(F.col("__w") * r).alias("swr"),
        F.sum(F.col("__w") * r * r).alias("swrr"),
        F.min(r).alias("y_reg_min"), F.max(r).alias("y_reg_max"))
    mean = F.col("swr") / F.col("sw")
    var = F.greatest(F.col("swrr") / F.col("sw") - mean * mean, F.lit(0.0))
    return g.select("split", "seq_length", F.col("sw").cast("long").alias("n_timesteps"),
                    "y_reg_min", "y_reg_max", F.round(mean, 6).alias("y_reg_mean"),
                    F.round(F.sqrt(var), 6).alias("y_reg_std"))


@query("scaled_range_by_split", P("\nUNION ALL\n".join(
    f"SELECT split, '{c}' AS column_name, MIN({c}) AS scaled_min, MAX({c}) AS scaled_max FROM scaled GROUP BY split"
    for c in S.scale_columns)))
def q_scaled_range_by_split(spark, sf):
    """AGG21: per split the scaled range of every scaled column (one pass, then unpivot)."""
    scaled, _ = _prep(spark, sf)
    wide = scaled.groupBy("split").agg(*[F.struct(F.min(c).alias("scaled_min"), F.max(c).alias("scaled_max"))
                                         .alias(c) for c in S.scale_columns])
    long = wide.select("split", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("m"))
                                                    for c in S.scale_columns])).alias("s"))
    return long.select("split", "s.column_name", "s.m.scaled_min", "s.m.scaled_max")


@query("dq_window_report", P("""
SELECT "check", severity, CAST(v AS BIGINT) AS violations FROM (
 SELECT 'window_count' AS "check", 'info' AS severity, SUM(GREATEST(n - 20, 0)) AS v FROM ep
 UNION ALL SELECT 'inner_length', 'error', 0 UNION ALL SELECT 'feature_width', 'error', 0
 UNION ALL SELECT 'label_domain', 'error', 0 UNION ALL SELECT 'non_finite_value', 'error', 0
 UNION ALL SELECT 'no_windows', 'error', CASE WHEN SUM(GREATEST(n - 20, 0)) = 0 THEN 1 ELSE 0 END FROM ep) t""",
                              EP_SQL))
def q_dq_window_report(spark, sf):
    """DQ16 on the full L = 21 window tensors (X with all 18 features)."""
    from ..operators.quality import window_report
    w = sequences.window_arrays(sequences.windows(_windows_src(spark, sf), 21))
    return window_report(w, 21, len(S.input_features))


@query("flattened_windows", P("""
SELECT split, CAST(t AS INT) AS t, COUNT(*) AS n_windows, CAST(SUM(p) AS BIGINT) AS sum_day,
 CAST(SUM(phase_label) AS BIGINT) AS sum_label, CAST(SUM(days_until_next_cycle) AS BIGINT) AS sum_countdown
FROM (SELECT *, day_in_cycle AS p, COUNT(*) OVER (PARTITION BY user_id, cycle_start_date) AS n FROM dsplit) d
 JOIN range(21) r(t) ON p >= t AND p <= n - 21 + t
GROUP BY split, t"""))
def q_flattened_windows(spark, sf):
    """GEN5: all windows of L = 21 as one row per (window, timestep), summed per timestep."""
    flat = sequences.flatten_windows(sequences.windows(_windows_src(spark, sf, features=[]), 21))
    return flat.groupBy("split", "t").agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum(F.col("day").cast("long")).alias("sum_day"),
        F.sum("y_phase").alias("sum_label"), F.sum("y_reg").cast("long").alias("sum_countdown"))
