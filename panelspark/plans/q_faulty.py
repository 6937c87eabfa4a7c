"""Catalog part 6 - the quality rules on panels that break them.

The clean panels give 0 for most rules, which a broken rule would give too. These queries put faults into panels
built from the driver tables (by a key of the episode, so DuckDB can repeat them) and report what the rules find."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality, scale, sequences, split
from ..operators.expand import expand_days
from ..operators.history import add_history
from ..session import materialize
from ..sources.tables import EPISODES_SQL, EPOCH, episodes, with_views
from ..spec import DEFAULT as S
from .pipelines import prepared_episodes, split_and_scale, split_daily, window_source
from .q_builder import DAILY_SQL, DQ_DAILY_ROWS, HISTORY_SQL, daily_report_sql, report_sql
from .q_prep import EP_SQL, P, range_report_sql
from .registry import query

K_SQL = f"(user_id * 1000 + datediff('day', DATE '{EPOCH}', cycle_start_date))"


def _k():
    return F.col("user_id") * 1000 + F.datediff("cycle_start_date", F.lit(EPOCH).cast("date"))


def _hit(m: int):
    return _k() % m == 0


def faulty_daily(daily):
    """Missing days, repeated days, shifted dates, bad labels, names and countdowns, and null history."""
    day = F.col(S.day)
    d = daily.filter(~(_hit(43) & (day == 3)))
    copies = F.when(_hit(47) & day.isin(5, 6), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    d = d.withColumn("__copy", F.explode(copies)).drop("__copy")
    return d.withColumns({
        S.sample_date: F.when(_hit(53) & (day == 7), F.date_add(S.sample_date, 1)).otherwise(F.col(S.sample_date)),
        S.label: F.when(_hit(59) & (day == 2), 9).when(_hit(73) & (day == 2), None).otherwise(F.col(S.label)),
        S.label_name: F.when(_hit(61) & (day == 4), "unknown").otherwise(F.col(S.label_name)),
        S.hist_length: F.when(_hit(67) & (day == 1), None).otherwise(F.col(S.hist_length)),
        S.countdown: F.when(_hit(71) & (day == 8), -1).otherwise(F.col(S.countdown))})


FAULTY_DAILY_SQL = f"""
fk AS (SELECT * FROM (SELECT *, {K_SQL} AS k FROM daily) t WHERE NOT (k % 43 = 0 AND day_in_cycle = 3)),
fu AS (SELECT * FROM fk UNION ALL SELECT * FROM fk WHERE k % 47 = 0 AND day_in_cycle IN (5, 6)),
faulty AS (SELECT user_id, cycle_start_date, day_in_cycle, cycle_length, hist_mean_period,
 CASE WHEN k % 53 = 0 AND day_in_cycle = 7 THEN CAST(sample_date + 1 AS DATE) ELSE sample_date END AS sample_date,
 CASE WHEN k % 59 = 0 AND day_in_cycle = 2 THEN 9 WHEN k % 73 = 0 AND day_in_cycle = 2 THEN NULL
  ELSE phase_label END AS phase_label,
 CASE WHEN k % 61 = 0 AND day_in_cycle = 4 THEN 'unknown' ELSE phase_name END AS phase_name,
 CASE WHEN k % 67 = 0 AND day_in_cycle = 1 THEN NULL ELSE hist_mean_cycle END AS hist_mean_cycle,
 CASE WHEN k % 71 = 0 AND day_in_cycle = 8 THEN -1 ELSE days_until_next_cycle END AS days_until_next_cycle
 FROM fu)"""


@query("dq_daily_faulty", with_views(report_sql(DQ_DAILY_ROWS), EPISODES_SQL, HISTORY_SQL, DAILY_SQL,
                                     FAULTY_DAILY_SQL, *daily_report_sql("faulty")))
def q_dq_daily_faulty(spark, sf):
    """DQ4-DQ6 / WIN6 on a faulty daily panel."""
    ep = materialize(prepared_episodes(episodes(spark, sf)))  # feeds the panel and the expected row total
    return quality.daily_report(faulty_daily(expand_days(ep)), ep)


@query("history_flag_faulty", with_views("""
SELECT 'first_episode_not_flagged' AS "check", 'error' AS severity,
 COUNT(*) FILTER (WHERE np = 0 AND flag <> 1) AS violations FROM f
UNION ALL SELECT 'later_episode_flagged', 'error', COUNT(*) FILTER (WHERE np > 0 AND flag <> 0) FROM f""",
    EPISODES_SQL, HISTORY_SQL, f"""
f AS (SELECT n_prior_episodes AS np, CASE WHEN {K_SQL} % 29 = 0 THEN 1 - is_historical_data_missing
  ELSE is_historical_data_missing END AS flag FROM hist)"""))
def q_history_flag_faulty(spark, sf):
    """DQ8 / WIN5 with the cold-start flag turned round in some episodes."""
    h = add_history(episodes(spark, sf))
    flag = F.col(S.cold_flag)
    return quality.history_flag_report(h.withColumn(S.cold_flag, F.when(_hit(29), 1 - flag).otherwise(flag)))


@query("scaled_faulty", P(range_report_sql("bad"), f"""
bad AS (SELECT * REPLACE (
  CASE WHEN {K_SQL} % 31 = 0 THEN NULL ELSE age END AS age,
  CASE WHEN {K_SQL} % 31 = 0 THEN 1.5e0 ELSE bmi END AS bmi,
  CASE WHEN {K_SQL} % 23 = 0 THEN -1e-10 ELSE sleep_hours END AS sleep_hours,
  CASE WHEN {K_SQL} % 37 = 0 THEN 2 WHEN {K_SQL} % 41 = 0 THEN NULL ELSE diet_balanced END AS diet_balanced,
  CASE WHEN {K_SQL} % 43 = 0 AND day_in_cycle_raw = 0 THEN NULL ELSE phase_label END AS phase_label)
 FROM scaled)"""))
def q_scaled_faulty(spark, sf):
    """DQ12-DQ14: a null and an out-of-range cell in one row, a value inside the train tolerance only,
    indicators other than 0 and 1, null targets."""
    scaled, _ = split_and_scale(episodes(spark, sf))
    return scale.range_report(scaled.withColumns({
        "age": F.when(~_hit(31), F.col("age")),
        "bmi": F.when(_hit(31), 1.5).otherwise(F.col("bmi")),
        "sleep_hours": F.when(_hit(23), -1e-10).otherwise(F.col("sleep_hours")),
        "diet_balanced": F.when(_hit(37), 2).when(_hit(41), None).otherwise(F.col("diet_balanced")),
        S.label: F.when(~(_hit(43) & (F.col("day_in_cycle_raw") == 0)), F.col(S.label))}))


@query("split_overlap_faulty", P("""
SELECT pair, CAST(n AS BIGINT) AS n_entities FROM (
 SELECT 'train&val' AS pair, COUNT(*) FILTER (WHERE tr AND va) AS n FROM u
 UNION ALL SELECT 'train&test', COUNT(*) FILTER (WHERE tr AND te) FROM u
 UNION ALL SELECT 'val&test', COUNT(*) FILTER (WHERE va AND te) FROM u
 UNION ALL SELECT 'covered', COUNT(*) FROM u) t""", """
leak AS (SELECT user_id, CASE WHEN user_id % 13 = 0 AND day_in_cycle = 0 THEN 'test'
  WHEN user_id % 11 = 0 AND day_in_cycle = 1 THEN 'val' ELSE split END AS split FROM dsplit)""", """
u AS (SELECT user_id, bool_or(split = 'train') AS tr, bool_or(split = 'val') AS va, bool_or(split = 'test') AS te
 FROM leak GROUP BY user_id)"""))
def q_split_overlap_faulty(spark, sf):
    """DQ15 / JN2: days of some entities moved to another split."""
    sp = split_daily(episodes(spark, sf))
    u, day = F.col("user_id"), F.col(S.day)
    return split.split_overlap(sp.withColumn("split", F.when((u % 13 == 0) & (day == 0), "test")
                                             .when((u % 11 == 0) & (day == 1), "val").otherwise(F.col("split"))))


@query("dq_window_faulty", P(f"""
SELECT "check", severity, CAST(v AS BIGINT) AS violations FROM (
 SELECT 'window_count' AS "check", 'info' AS severity, SUM(w) AS v FROM e
 UNION ALL SELECT 'inner_length', 'error', SUM(CASE WHEN k % 31 = 0 THEN 1 ELSE 0 END) FROM e
 UNION ALL SELECT 'feature_width', 'error', SUM(CASE WHEN k % 37 = 0 THEN w ELSE 0 END) FROM e
 UNION ALL SELECT 'label_domain', 'error', SUM(CASE WHEN k % 43 = 0 THEN 1 ELSE 0 END) FROM e
 UNION ALL SELECT 'non_finite_value', 'error', SUM(CASE WHEN k % 41 = 0 OR k % 47 = 0 THEN w ELSE 0 END) FROM e
 UNION ALL SELECT 'no_windows', 'error', CASE WHEN COUNT(*) = 0 THEN 1 ELSE 0 END FROM e) t""", EP_SQL, f"""
e AS (SELECT {K_SQL} AS k, n - 20 AS w FROM ep WHERE n >= 21)"""))
def q_dq_window_faulty(spark, sf):
    """DQ16: first windows one step short or with a null label; too narrow rows; NaN and infinite values."""
    w = sequences.window_arrays(sequences.windows(window_source(episodes(spark, sf)), 21))
    first = F.col("window_start") == 0
    nan = F.lit(float("nan")).cast("float")
    n = len(S.input_features)
    # one fault after the other, so a window can have several
    w = w.withColumn("X", F.when(_hit(41), F.transform("X", lambda r: F.concat(F.array(nan), F.slice(r, 2, n - 1))))
                     .otherwise(F.col("X")))
    w = w.withColumn("X", F.when(_hit(37), F.transform("X", lambda r: F.slice(r, 1, n - 1))).otherwise(F.col("X")))
    w = w.withColumns({
        "X": F.when(_hit(31) & first, F.slice("X", 1, 20)).otherwise(F.col("X")),
        "y_phase": F.when(_hit(43) & first, F.concat(F.slice("y_phase", 1, 20), F.array(F.lit(None).cast("int"))))
        .otherwise(F.col("y_phase")),
        "y_reg": F.when(_hit(47), F.transform("y_reg", lambda v: F.lit(float("inf")).cast("float")))
        .otherwise(F.col("y_reg"))})
    return quality.window_report(w, 21, n)
