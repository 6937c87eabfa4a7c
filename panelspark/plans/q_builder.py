"""Catalog part 1 - entry A: cleaning, history, expansion, encoding, data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, encode, quality
from ..operators.history import add_history
from ..sources.tables import (EPISODES_DIRTY_SQL, EPISODES_SQL, episodes,
                              episodes_dirty, episodes_with_duplicates, with_views)
from ..spec import DEFAULT as S
from ..spec import MULTILABEL_PATTERN, MULTILABEL_PATTERN_EDA
from ..operators.expand import expand_days
from ..session import materialize
from .pipelines import daily_panel, ordered_daily, prepared_episodes

from .registry import query


def E(body: str) -> str:
    """SQL over the ``episodes`` view."""
    return with_views(body, EPISODES_SQL)


def ED(body: str) -> str:
    """SQL over the ``episodes_dirty`` view."""
    return with_views(body, EPISODES_SQL, EPISODES_DIRTY_SQL)


# --- shared SQL fragments ---------------------------------------------------

HISTORY_SQL = """
hist AS (
 SELECT *, CAST(CASE WHEN ml IS NULL OR mp IS NULL THEN 1 ELSE 0 END AS INT) AS is_historical_data_missing,
  round_even(COALESCE(ml, 29.3e0) * 100.0e0, 0) / 100.0e0 AS hist_mean_cycle,
  round_even(COALESCE(mp, 4.0e0) * 100.0e0, 0) / 100.0e0 AS hist_mean_period,
  CAST(np AS BIGINT) AS n_prior_episodes
 FROM (SELECT *, AVG(cycle_length) OVER w AS ml, AVG(period_length) OVER w AS mp,
        COUNT(*) OVER w AS np
       FROM episodes
       WINDOW w AS (PARTITION BY user_id ORDER BY cycle_start_date, next_cycle_start_date, cycle_length,
                    period_length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) h)"""

ENCODE_COLS_SQL = """
  CAST(CASE exercise_frequency WHEN 'Low' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'High' THEN 2 END AS INT)
    AS exercise_frequency_encoded,
  CAST(COALESCE(diet = 'Balanced', false) AS INT) AS diet_balanced,
  CAST(COALESCE(diet = 'High Sugar', false) AS INT) AS diet_high_sugar,
  CAST(COALESCE(diet = 'Low Carb', false) AS INT) AS diet_low_carb,
  CAST(COALESCE(diet = 'Vegetarian', false) AS INT) AS diet_vegetarian,
  CAST(COALESCE(symptoms = 'Bloating', false) AS INT) AS symptoms_bloating,
  CAST(COALESCE(symptoms = 'Cramps', false) AS INT) AS symptoms_cramps,
  CAST(COALESCE(symptoms = 'Fatigue', false) AS INT) AS symptoms_fatigue,
  CAST(COALESCE(symptoms = 'Headache', false) AS INT) AS symptoms_headache,
  CAST(COALESCE(symptoms = 'Mood Swings', false) AS INT) AS symptoms_mood_swings"""

DAILY_SQL = """
daily AS (
 SELECT d.*, CAST(datediff('day', sample_date, next_cycle_start_date) AS INT) AS days_until_next_cycle,
  CASE phase_label WHEN 0 THEN 'menstruation' WHEN 1 THEN 'follicular' WHEN 2 THEN 'ovulation'
   ELSE 'luteal' END AS phase_name
 FROM (SELECT x.*, CAST(x.cycle_start_date + day_in_cycle AS DATE) AS sample_date,
        CAST(CASE WHEN day_in_cycle < period_length THEN 0 WHEN day_in_cycle < cycle_length - 14 THEN 1
         WHEN day_in_cycle = cycle_length - 14 THEN 2 ELSE 3 END AS INT) AS phase_label
       FROM (SELECT h.*, """ + ENCODE_COLS_SQL + """,
              CAST(unnest(generate_series(0, cycle_length - 1)) AS INT) AS day_in_cycle
             FROM hist h) x) d)"""

DAILY_COLUMNS_SQL = ", ".join(S.daily_columns)


def D(body: str) -> str:
    """SQL over the daily panel built from ``episodes``."""
    return with_views(body, EPISODES_SQL, HISTORY_SQL, DAILY_SQL)


def _daily(spark, sf):
    return daily_panel(episodes(spark, sf))


def _parsed_dirty(spark, sf):
    return clean.parse_dates(episodes_dirty(spark, sf))


# --- entry A: cleaning, history, expansion ---------------------------------

@query("parse_dates", ED("""
SELECT user_id, cycle_length, period_length, TRY_CAST(cycle_start_date AS DATE) AS cycle_start_date,
 TRY_CAST(next_cycle_start_date AS DATE) AS next_cycle_start_date FROM episodes_dirty"""))
def q_parse_dates(spark, sf):
    return _parsed_dirty(spark, sf).select("user_id", "cycle_length", "period_length",
                                           "cycle_start_date", "next_cycle_start_date")


@query("date_parse_failures", ED("""
SELECT 'cycle_start_date' AS column_name, CAST(COUNT(*) FILTER (WHERE cycle_start_date IS NOT NULL
  AND TRY_CAST(cycle_start_date AS DATE) IS NULL) AS BIGINT) AS n_failed FROM episodes_dirty
UNION ALL
SELECT 'next_cycle_start_date', CAST(COUNT(*) FILTER (WHERE next_cycle_start_date IS NOT NULL
  AND TRY_CAST(next_cycle_start_date AS DATE) IS NULL) AS BIGINT) FROM episodes_dirty"""))
def q_date_parse_failures(spark, sf):
    return clean.parse_failures(episodes_dirty(spark, sf))


@query("drop_bad_dates", ED("""
SELECT * FROM (SELECT user_id, cycle_length, period_length, TRY_CAST(cycle_start_date AS DATE) AS cycle_start_date,
 TRY_CAST(next_cycle_start_date AS DATE) AS next_cycle_start_date FROM episodes_dirty) t
WHERE cycle_start_date IS NOT NULL AND next_cycle_start_date IS NOT NULL"""))
def q_drop_bad_dates(spark, sf):
    return clean.drop_bad_dates(_parsed_dirty(spark, sf)).select(
        "user_id", "cycle_length", "period_length", "cycle_start_date", "next_cycle_start_date")


@query("history_features", with_views("""
SELECT user_id, cycle_start_date, cycle_length, period_length, hist_mean_cycle, hist_mean_period,
 is_historical_data_missing, n_prior_episodes FROM hist""", EPISODES_SQL, HISTORY_SQL))
def q_history_features(spark, sf):
    return add_history(episodes(spark, sf)).select(
        "user_id", "cycle_start_date", "cycle_length", "period_length", "hist_mean_cycle",
        "hist_mean_period", "is_historical_data_missing", "n_prior_episodes")


@query("history_flag_check", with_views("""
SELECT 'first_episode_not_flagged' AS "check", 'error' AS severity,
 CAST(COUNT(*) FILTER (WHERE n_prior_episodes = 0 AND is_historical_data_missing <> 1) AS BIGINT) AS violations
FROM hist
UNION ALL
SELECT 'later_episode_flagged', 'error',
 CAST(COUNT(*) FILTER (WHERE n_prior_episodes > 0 AND is_historical_data_missing <> 0) AS BIGINT) FROM hist""",
                                        EPISODES_SQL, HISTORY_SQL))
def q_history_flag_check(spark, sf):
    return quality.history_flag_report(add_history(episodes(spark, sf)))


@query("daily_panel", D(f"SELECT {DAILY_COLUMNS_SQL} FROM daily"))
def q_daily_panel(spark, sf):
    return ordered_daily(_daily(spark, sf))


@query("daily_phase_counts", D("""
SELECT phase_label, phase_name, COUNT(*) AS n_rows, CAST(SUM(day_in_cycle) AS BIGINT) AS sum_day,
 CAST(SUM(days_until_next_cycle) AS BIGINT) AS sum_countdown
FROM daily GROUP BY phase_label, phase_name"""))
def q_daily_phase_counts(spark, sf):
    return daily_phase_counts(_daily(spark, sf))


def daily_phase_counts(daily):
    return daily.groupBy("phase_label", "phase_name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("day_in_cycle").cast("long").alias("sum_day"),
        F.sum("days_until_next_cycle").cast("long").alias("sum_countdown"))


@query("countdown_target", E("""
SELECT user_id, cycle_start_date, next_cycle_start_date,
 CAST(datediff('day', cycle_start_date, next_cycle_start_date) AS INT) AS days_until_next_cycle_at_cycle_start
FROM episodes"""))
def q_countdown_target(spark, sf):
    return countdown_at_start(episodes(spark, sf))


def countdown_at_start(ep, spec=S):
    """PRJ19: the regression target on day 0 of every episode."""
    return ep.select(spec.entity, spec.start, spec.next_start,
                     F.datediff(spec.next_start, spec.start).alias(
                         "days_until_next_cycle_at_cycle_start"))


@query("countdown_preview", E("""
SELECT user_id, cycle_start_date, next_cycle_start_date,
 CAST(datediff('day', cycle_start_date, next_cycle_start_date) AS INT) AS days_until_next_cycle_at_cycle_start
FROM episodes ORDER BY user_id, cycle_start_date LIMIT 8"""))
def q_countdown_preview(spark, sf):
    # SRT4: a head of 8 rows is the feature; ordered by keys so it is reproducible
    return countdown_at_start(episodes(spark, sf)).orderBy("user_id", "cycle_start_date").limit(8)


@query("date_length_check", E("""
SELECT user_id, cycle_start_date, next_cycle_start_date, cycle_length,
 CAST(datediff('day', cycle_start_date, next_cycle_start_date) AS INT) AS computed_cycle_length,
 CAST(datediff('day', cycle_start_date, next_cycle_start_date) - cycle_length AS INT) AS cycle_length_difference
FROM episodes"""))
def q_date_length_check(spark, sf):
    return clean.date_length(episodes(spark, sf)).select(
        "user_id", "cycle_start_date", "next_cycle_start_date", "cycle_length",
        "computed_cycle_length", "cycle_length_difference")


_MISMATCH_SQL = """
SELECT * FROM (SELECT user_id, cycle_start_date, next_cycle_start_date, cycle_length,
  CAST(datediff('day', cycle_start_date, next_cycle_start_date) AS INT) AS computed_cycle_length,
  CAST(datediff('day', cycle_start_date, next_cycle_start_date) - cycle_length AS INT) AS cycle_length_difference
 FROM (SELECT user_id, cycle_length, TRY_CAST(cycle_start_date AS DATE) AS cycle_start_date,
        TRY_CAST(next_cycle_start_date AS DATE) AS next_cycle_start_date FROM episodes_dirty) p
 WHERE cycle_start_date IS NOT NULL AND next_cycle_start_date IS NOT NULL) t
WHERE cycle_length_difference <> 0"""


@query("length_mismatch", ED(_MISMATCH_SQL))
def q_length_mismatch(spark, sf):
    return clean.length_mismatch(clean.drop_bad_dates(_parsed_dirty(spark, sf)))


@query("length_mismatch_head", ED(_MISMATCH_SQL + " ORDER BY user_id, cycle_start_date LIMIT 5"))
def q_length_mismatch_head(spark, sf):
    # PRJ6: the notebook shows the first five inconsistent rows
    return clean.length_mismatch(clean.drop_bad_dates(_parsed_dirty(spark, sf)), n=5)


# --- encodings --------------------------------------------------------------

@query("onehot_encode", ED("""
SELECT user_id, cycle_start_date, diet, symptoms,""" + ENCODE_COLS_SQL.split("AS exercise_frequency_encoded,")[1]
                           + " FROM episodes_dirty"))
def q_onehot_encode(spark, sf):
    d = episodes_dirty(spark, sf)
    for column, values in S.onehot:
        d = encode.onehot(d, column, values)
    return d.select("user_id", "cycle_start_date", "diet", "symptoms", *S.onehot_columns)


@query("ordinal_encode", ED("""
SELECT user_id, cycle_start_date, exercise_frequency,
 CAST(CASE exercise_frequency WHEN 'Low' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'High' THEN 2 END AS INT)
  AS exercise_frequency_encoded FROM episodes_dirty"""))
def q_ordinal_encode(spark, sf):
    d = encode.ordinal(episodes_dirty(spark, sf), "exercise_frequency", S.ordinal[0][1])
    return d.select("user_id", "cycle_start_date", "exercise_frequency", "exercise_frequency_encoded")


@query("unexpected_categories", ED("""
SELECT 'exercise_frequency' AS column_name, exercise_frequency AS value, COUNT(*) AS n_rows FROM episodes_dirty
 WHERE NOT COALESCE(exercise_frequency IN ('Low', 'Moderate', 'High'), false) GROUP BY exercise_frequency
UNION ALL
SELECT 'diet', diet, COUNT(*) FROM episodes_dirty
 WHERE NOT COALESCE(diet IN ('Balanced', 'High Sugar', 'Low Carb', 'Vegetarian'), false) GROUP BY diet
UNION ALL
SELECT 'symptoms', symptoms, COUNT(*) FROM episodes_dirty
 WHERE NOT COALESCE(symptoms IN ('Bloating', 'Cramps', 'Fatigue', 'Headache', 'Mood Swings'), false)
 GROUP BY symptoms"""))
def q_unexpected_categories(spark, sf):
    return encode.unexpected_categories(episodes_dirty(spark, sf))


@query("multilabel_values", ED(f"""
SELECT 'diet' AS column_name, 'builder' AS pattern_set,
 CAST(COUNT(*) FILTER (WHERE regexp_matches(diet, '{MULTILABEL_PATTERN}')) AS BIGINT) AS n_multilabel FROM episodes_dirty
UNION ALL
SELECT 'symptoms', 'builder',
 CAST(COUNT(*) FILTER (WHERE regexp_matches(symptoms, '{MULTILABEL_PATTERN}')) AS BIGINT) FROM episodes_dirty
UNION ALL
SELECT 'symptoms', 'notebook',
 CAST(COUNT(*) FILTER (WHERE regexp_matches(symptoms, '{MULTILABEL_PATTERN_EDA}')) AS BIGINT) FROM episodes_dirty"""))
def q_multilabel_values(spark, sf):
    d = episodes_dirty(spark, sf)
    a = encode.multilabel_values(d, ("diet", "symptoms"), MULTILABEL_PATTERN) \
        .withColumn("pattern_set", F.lit("builder"))
    b = encode.multilabel_values(d, ("symptoms",), MULTILABEL_PATTERN_EDA) \
        .withColumn("pattern_set", F.lit("notebook"))
    return a.unionByName(b)


@query("onehot_row_sum", ED("""
SELECT 'diet' AS family, CAST(COUNT(*) FILTER (WHERE COALESCE(diet IN ('Balanced', 'High Sugar', 'Low Carb',
  'Vegetarian'), false) = false) AS BIGINT) AS n_rows_sum_not_1 FROM episodes_dirty
UNION ALL
SELECT 'symptoms', CAST(COUNT(*) FILTER (WHERE COALESCE(symptoms IN ('Bloating', 'Cramps', 'Fatigue', 'Headache',
  'Mood Swings'), false) = false) AS BIGINT) FROM episodes_dirty"""))
def q_onehot_row_sum(spark, sf):
    return encode.onehot_row_sums(encode.encode_categories(episodes_dirty(spark, sf)))


# --- data-quality reports ---------------------------------------------------

_DQ_EPISODE_SQL = """
p AS (SELECT user_id, cycle_length, period_length, exercise_frequency, diet, symptoms,
  TRY_CAST(cycle_start_date AS DATE) AS cycle_start_date, TRY_CAST(next_cycle_start_date AS DATE) AS next_cycle_start_date
 FROM episodes_dirty),
c AS (SELECT * FROM p WHERE cycle_start_date IS NOT NULL AND next_cycle_start_date IS NOT NULL),
a AS (SELECT
 COUNT(*) FILTER (WHERE user_id IS NULL) AS null_entity_key,
 COUNT(*) FILTER (WHERE NOT COALESCE(cycle_length > 0, false)) AS length_positive,
 COUNT(*) FILTER (WHERE NOT COALESCE(period_length > 0, false)) AS prefix_positive,
 COUNT(*) FILTER (WHERE NOT COALESCE(period_length < cycle_length, false)) AS prefix_below_length,
 COUNT(*) FILTER (WHERE NOT COALESCE(next_cycle_start_date > cycle_start_date, false)) AS next_after_start,
 COUNT(*) FILTER (WHERE COALESCE(cycle_length - 14 <= period_length, false)) AS phase_overlap,
 COUNT(*) FILTER (WHERE COALESCE(cycle_length - 14 >= cycle_length, false)) AS ovulation_outside_episode,
 COUNT(*) FILTER (WHERE COALESCE(datediff('day', cycle_start_date, next_cycle_start_date) <> cycle_length, false))
  AS length_date_mismatch,
 COUNT(*) FILTER (WHERE NOT COALESCE(exercise_frequency IN ('Low', 'Moderate', 'High'), false))
  AS exercise_frequency_ordinal_invalid,
 COUNT(*) FILTER (WHERE NOT COALESCE(diet IN ('Balanced', 'High Sugar', 'Low Carb', 'Vegetarian'), false))
  AS diet_onehot_sum_not_1,
 COUNT(*) FILTER (WHERE NOT COALESCE(symptoms IN ('Bloating', 'Cramps', 'Fatigue', 'Headache', 'Mood Swings'), false))
  AS symptoms_onehot_sum_not_1
 FROM c)"""

_DQ_EPISODE_ROWS = [
    ("null_entity_key", "error"), ("length_positive", "error"), ("prefix_positive", "error"),
    ("prefix_below_length", "error"), ("next_after_start", "error"), ("phase_overlap", "warn"),
    ("ovulation_outside_episode", "warn"), ("length_date_mismatch", "info"),
    ("exercise_frequency_ordinal_invalid", "error"), ("diet_onehot_sum_not_1", "warn"),
    ("symptoms_onehot_sum_not_1", "warn"),
]


def report_sql(rows, source="a"):
    return "\nUNION ALL\n".join(
        f"SELECT '{n}' AS \"check\", '{s}' AS severity, CAST({n} AS BIGINT) AS violations FROM {source}"
        for n, s in rows)


@query("dq_episode_report", with_views(report_sql(_DQ_EPISODE_ROWS), EPISODES_SQL, EPISODES_DIRTY_SQL,
                                       _DQ_EPISODE_SQL))
def q_dq_episode_report(spark, sf):
    ep = clean.drop_bad_dates(_parsed_dirty(spark, sf))
    return quality.episode_report(encode.encode_categories(ep))


@query("duplicate_episodes", E("""
SELECT user_id, cycle_start_date, COUNT(*) AS n_rows FROM
 (SELECT * FROM episodes UNION ALL SELECT * FROM episodes WHERE user_id % 97 = 0) t
GROUP BY user_id, cycle_start_date HAVING COUNT(*) > 1"""))
def q_duplicate_episodes(spark, sf):
    return quality.duplicate_episodes(episodes_with_duplicates(spark, sf))


@query("nonchronological_entities", """
SELECT user_id, CAST(COUNT(*) FILTER (WHERE prev > cycle_start_date) AS BIGINT) AS n_inversions
FROM (SELECT user_id, cycle_start_date, LAG(cycle_start_date) OVER (PARTITION BY user_id ORDER BY o_orderkey) AS prev
      FROM (SELECT CAST(o_custkey AS BIGINT) AS user_id, o_orderkey, CAST(o_orderdate AS DATE) AS cycle_start_date
            FROM orders) o) t
GROUP BY user_id HAVING COUNT(*) FILTER (WHERE prev > cycle_start_date) > 0""")
def q_nonchronological_entities(spark, sf):
    # arrival order = order key (file order); start = order date
    from ..sources.tables import table
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("user_id"),
                                          "o_orderkey",
                                          F.to_date("o_orderdate").alias("cycle_start_date"))
    return quality.nonchronological_entities(o, "o_orderkey")


@query("phase_rule_violations", ED("""
SELECT user_id, cycle_start_date, cycle_length, period_length, cycle_length - 14 AS ovulation_day,
 CASE WHEN cycle_length - 14 <= period_length THEN 'phase_overlap' ELSE 'ovulation_outside_episode' END AS rule
FROM episodes_dirty
WHERE COALESCE(cycle_length - 14 <= period_length, false) OR COALESCE(cycle_length - 14 >= cycle_length, false)"""))
def q_phase_rule_violations(spark, sf):
    return quality.phase_rule_violations(episodes_dirty(spark, sf))


DQ_DAILY_ROWS = [
    ("daily_rows_equal_length_sum", "error"), ("countdown_negative", "error"), ("label_domain", "error"),
    ("label_name_domain", "error"), ("history_null", "error"), ("episode_day_set", "error"),
    ("sample_date_increasing", "error"),
]


def daily_report_sql(panel: str) -> tuple[str, ...]:
    """Views that end in ``a``: one row of violation counts of the daily panel ``panel``."""
    return (f"""
pd AS (SELECT user_id, cycle_start_date, day_in_cycle, COUNT(*) AS c, MAX(cycle_length) AS len,
  COUNT(*) FILTER (WHERE sample_date IS DISTINCT FROM CAST(cycle_start_date + day_in_cycle AS DATE)) AS date_off
 FROM {panel} GROUP BY user_id, cycle_start_date, day_in_cycle),
pe AS (SELECT user_id, cycle_start_date, SUM(c) AS rows, COUNT(*) AS days, MIN(day_in_cycle) AS dmin,
  MAX(day_in_cycle) AS dmax, MAX(len) AS len, SUM(date_off) AS date_off
 FROM pd GROUP BY user_id, cycle_start_date),
a AS (SELECT
 abs((SELECT COUNT(*) FROM {panel}) - (SELECT SUM(cycle_length) FROM episodes)) AS daily_rows_equal_length_sum,
 (SELECT COUNT(*) FILTER (WHERE NOT COALESCE(days_until_next_cycle >= 0, false)) FROM {panel}) AS countdown_negative,
 (SELECT COUNT(*) FILTER (WHERE NOT COALESCE(phase_label IN (0, 1, 2, 3), false)) FROM {panel}) AS label_domain,
 (SELECT COUNT(*) FILTER (WHERE NOT COALESCE(phase_name IN ('menstruation', 'follicular', 'ovulation', 'luteal'),
   false)) FROM {panel}) AS label_name_domain,
 (SELECT COUNT(*) FILTER (WHERE hist_mean_cycle IS NULL OR hist_mean_period IS NULL) FROM {panel}) AS history_null,
 (SELECT COUNT(*) FILTER (WHERE NOT COALESCE(rows = len AND days = len AND dmin = 0 AND dmax = len - 1, false))
  FROM pe) AS episode_day_set,
 (SELECT COUNT(*) FILTER (WHERE date_off > 0) FROM pe) AS sample_date_increasing)""",)


@query("dq_daily_report", with_views(report_sql(DQ_DAILY_ROWS), EPISODES_SQL, HISTORY_SQL, DAILY_SQL,
                                     *daily_report_sql("daily")))
def q_dq_daily_report(spark, sf):
    # the episode table feeds the daily panel and the expected row total: computed once
    ep = materialize(prepared_episodes(episodes(spark, sf)))
    return quality.daily_report(expand_days(ep), ep)


_LABELS_DAILY = ", ".join(f"COUNT(*) FILTER (WHERE phase_label = {i}) AS rows_label_{i}, "
                          f"COUNT(*) FILTER (WHERE phase_name = '{n}') AS rows_{n}" for i, n in enumerate(S.phase_names))
_LEVELS_DAILY = ", ".join(f"COUNT(*) FILTER (WHERE exercise_frequency_encoded = {i}) AS rows_exercise_{i}"
                          for i in range(len(S.ordinal[0][1])))
# the episodes in the order they arrive: by order key, which is not their order in time
_ARRIVAL_SQL = """
arrival AS (SELECT user_id, cycle_start_date, LAG(cycle_start_date) OVER (PARTITION BY user_id ORDER BY o_orderkey) AS prev
 FROM (SELECT CAST(o_custkey AS BIGINT) AS user_id, o_orderkey, CAST(o_orderdate AS DATE) AS cycle_start_date FROM orders) o)"""
_ONEHOT_DAILY = ", ".join(f"CAST(SUM({c}) AS BIGINT) AS total_{c}" for c in S.onehot_columns)


def days_by_label(spec=S):
    """Days of an episode with each phase label, from its length and prefix alone (the rule of ``phase_label``)."""
    n, p = F.col(spec.length).cast("long"), F.col(spec.prefix).cast("long")
    ovu, none = n - spec.ovulation_offset, F.lit(0).cast("long")
    first = F.greatest(F.least(p, n), none)
    second = F.greatest(F.least(ovu, n) - first, none)
    third = F.when((ovu >= first) & (ovu < n), 1).otherwise(0).cast("long")
    return first, second, third, n - first - second - third


@query("builder_summary", with_views(f"""
SELECT (SELECT COUNT(*) FROM episodes) AS n_episodes, COUNT(*) AS n_daily_rows,
 COUNT(DISTINCT user_id) AS n_entities, MIN(cycle_length) AS min_cycle_length, MAX(cycle_length) AS max_cycle_length,
 MIN(period_length) AS min_period_length, MAX(period_length) AS max_period_length,
 (SELECT COUNT(*) FROM episodes WHERE cycle_length - 14 <= period_length OR cycle_length - 14 >= cycle_length)
  AS n_phase_rule_violations,
 CAST(SUM(is_historical_data_missing) AS BIGINT) AS n_cold_start_rows,
 COUNT(*) FILTER (WHERE is_historical_data_missing = 0) AS n_history_rows,
 (SELECT COUNT(*) FROM (SELECT user_id FROM arrival GROUP BY user_id HAVING COUNT(*) FILTER (WHERE prev > cycle_start_date) > 0))
  AS n_unsorted_entities,
 (SELECT CAST(COALESCE(SUM(c), 0) AS BIGINT) FROM (SELECT COUNT(*) AS c FROM episodes GROUP BY user_id, cycle_start_date HAVING COUNT(*) > 1))
  AS n_duplicate_rows,
 {_LABELS_DAILY}, {_LEVELS_DAILY},
 CAST(SUM(CASE WHEN diet_balanced + diet_high_sugar + diet_low_carb + diet_vegetarian <> 1 THEN 1 ELSE 0 END)
  AS BIGINT) AS diet_rowsum_violations,
 CAST(SUM(CASE WHEN symptoms_bloating + symptoms_cramps + symptoms_fatigue + symptoms_headache
  + symptoms_mood_swings <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS symptoms_rowsum_violations,
 {_ONEHOT_DAILY}
FROM daily""", EPISODES_SQL, HISTORY_SQL, DAILY_SQL, _ARRIVAL_SQL))
def q_builder_summary(spark, sf):
    """AGG20: the builder's summary as one row.  Every daily-level total is an
    episode-level sum weighted by the episode length (each episode contributes
    ``length`` identical rows), so no explode is needed."""
    from ..sources.tables import table
    ep = prepared_episodes(episodes(spark, sf))
    n = F.col("cycle_length").cast("long")
    ovu = F.col("cycle_length") - 14
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("user_id"), "o_orderkey",
                                          F.to_date("o_orderdate").alias("cycle_start_date"))
    unsorted = quality.nonchronological_entities(o, "o_orderkey").agg(F.count(F.lit(1)).alias("n_unsorted_entities"))
    repeated = quality.duplicate_episodes(ep).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_duplicate_rows"))
    days = days_by_label()
    diet = sum(F.col(c) for c in S.onehot_columns if c.startswith("diet_"))
    sym = sum(F.col(c) for c in S.onehot_columns if c.startswith("symptoms_"))
    # one-row frames
    return unsorted.crossJoin(repeated).crossJoin(ep.agg(
        *[F.sum(d).alias(name) for i, d in enumerate(days) for name in (f"rows_label_{i}", f"rows_{S.phase_names[i]}")],
        *[F.sum(F.when(F.col("exercise_frequency_encoded") == i, n).otherwise(0)).alias(f"rows_exercise_{i}")
          for i in range(len(S.ordinal[0][1]))],
        F.sum((1 - F.col("is_historical_data_missing")) * n).alias("n_history_rows"),
        F.count(F.lit(1)).alias("n_episodes"), F.sum(n).alias("n_daily_rows"),
        F.countDistinct("user_id").alias("n_entities"),
        F.min("cycle_length").alias("min_cycle_length"), F.max("cycle_length").alias("max_cycle_length"),
        F.min("period_length").alias("min_period_length"), F.max("period_length").alias("max_period_length"),
        F.sum(((ovu <= F.col("period_length")) | (ovu >= F.col("cycle_length"))).cast("long"))
        .alias("n_phase_rule_violations"),
        F.sum(F.col("is_historical_data_missing") * n).alias("n_cold_start_rows"),
        F.sum(F.when(diet != 1, n).otherwise(0)).alias("diet_rowsum_violations"),
        F.sum(F.when(sym != 1, n).otherwise(0)).alias("symptoms_rowsum_violations"),
        *[F.sum(F.col(c) * n).alias(f"total_{c}") for c in S.onehot_columns]))
