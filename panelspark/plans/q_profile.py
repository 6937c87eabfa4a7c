"""Catalog part 3 - entry D: the exploratory profile (notebook) on whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, profile
from ..operators.sequences import windows_by_position
from ..sources.tables import (EPISODES_DIRTY_SQL, EPISODES_SQL, GAP_EPISODES_SQL, episodes,
                              episodes_dirty, episodes_with_duplicates, event_groups, gap_episodes,
                              table, with_views)
from .registry import query

NUM = ["age", "bmi", "stress_level", "sleep_hours", "cycle_length", "period_length"]
CAT = ["exercise_frequency", "diet", "symptoms"]
LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def E(body: str, *more) -> str:
    return with_views(body, EPISODES_SQL, *more)


def rhe(x: str, d: int = 2) -> str:
    """SQL twin of ``round_half_even``."""
    s = f"{10 ** d}.0e0"
    return f"round_even(({x}) * {s}, 0) / {s}"


@query("episodes_per_entity", E("SELECT user_id, COUNT(*) AS n_episodes FROM episodes GROUP BY user_id"))
def q_episodes_per_entity(spark, sf):
    return profile.episodes_per_entity(episodes(spark, sf))


@query("entity_overview", E(f"""
SELECT COUNT(*) AS n_entities, CAST(SUM(n) AS BIGINT) AS n_rows, {rhe('AVG(n)')} AS mean_per_entity,
 MIN(n) AS min_per_entity, quantile_cont(CAST(n AS DOUBLE), 0.5) AS median_per_entity, MAX(n) AS max_per_entity
FROM (SELECT user_id, COUNT(*) AS n FROM episodes GROUP BY user_id) t"""))
def q_entity_overview(spark, sf):
    return profile.entity_overview(episodes(spark, sf))


def _describe_sql(src: str, cols) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, COUNT({x}) AS count, {rhe(f'AVG({x})')} AS mean, "
            f"{rhe(f'STDDEV_SAMP({x})')} AS std, {rhe(f'MIN({x})')} AS min, "
            f"{rhe(f'quantile_cont({x}, 0.25)')} AS p25, {rhe(f'quantile_cont({x}, 0.5)')} AS p50, "
            f"{rhe(f'quantile_cont({x}, 0.75)')} AS p75, {rhe(f'MAX({x})')} AS max FROM {src}")
    return "\nUNION ALL\n".join(parts)


@query("describe_numeric", E(_describe_sql("episodes", NUM)))
def q_describe_numeric(spark, sf):
    return profile.describe(episodes(spark, sf), NUM)


@query("describe_lineitem", _describe_sql("lineitem", LINE_NUM))
def q_describe_lineitem(spark, sf):
    return profile.describe(table(spark, sf, "lineitem"), LINE_NUM)


DIRTY_TYPES = {"bmi": "double", "sleep_hours": "double"}
DIRTY_COLS = ["user_id", "age", "bmi", "stress_level", "exercise_frequency", "sleep_hours", "diet",
              "cycle_start_date", "cycle_length", "period_length", "next_cycle_start_date", "symptoms"]


def _missing_sql():
    parts = []
    for c in DIRTY_COLS:
        cond = f"{c} IS NULL" + (f" OR isnan({c})" if c in DIRTY_TYPES else "")
        n = f"COUNT(*) FILTER (WHERE {cond})"
        parts.append(f"SELECT '{c}' AS column_name, {n} AS n_missing, "
                     f"{rhe(f'{n} * 100.0e0 / COUNT(*)')} AS pct_missing FROM episodes_dirty")
    return with_views("\nUNION ALL\n".join(parts), EPISODES_SQL, EPISODES_DIRTY_SQL)


@query("missing_values", _missing_sql())
def q_missing_values(spark, sf):
    return profile.missing_values(episodes_dirty(spark, sf), DIRTY_COLS)


@query("duplicate_rows", E("""
SELECT CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM d) x) AS BIGINT) AS n_duplicate_rows
FROM d""", "d AS (SELECT * FROM episodes UNION ALL SELECT * FROM episodes WHERE user_id % 97 = 0)"))
def q_duplicate_rows(spark, sf):
    return profile.duplicate_rows(episodes_with_duplicates(spark, sf))


_VC = [("episodes", "exercise_frequency"), ("episodes", "diet"), ("episodes", "symptoms"),
       ("orders", "o_orderpriority"), ("customer", "c_mktsegment"), ("events", "event_type")]


@query("value_counts", E("\nUNION ALL\n".join(
    f"SELECT '{s}' AS source, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS n_rows "
    f"FROM {s} GROUP BY {c}" for s, c in _VC)))
def q_value_counts(spark, sf):
    ep = episodes(spark, sf)
    srcs = {"episodes": ep}
    parts = []
    for s, c in _VC:
        df = srcs[s] if s in srcs else table(spark, sf, s)
        parts.append(profile.value_counts(df, c, s))
    return reduce(DataFrame.unionByName, parts)


@query("distinct_values", E("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) OVER () AS n_distinct "
    f"FROM (SELECT DISTINCT {c} FROM episodes WHERE {c} IS NOT NULL) t{i}" for i, c in enumerate(CAT))))
def q_distinct_values(spark, sf):
    return profile.distinct_values(episodes(spark, sf), CAT)


ENTITY_STATS_SQL = """
es AS (SELECT user_id, round(AVG(cycle_length), 6) AS mean_cycle_length,
  round(COALESCE(STDDEV_SAMP(cycle_length), 0.0e0), 6) AS std_cycle_length,
  round(AVG(period_length), 6) AS mean_period_length, round(AVG(stress_level), 6) AS mean_stress,
  round(AVG(sleep_hours), 6) AS mean_sleep, COUNT(cycle_length) AS n_cycles
 FROM episodes GROUP BY user_id)"""


@query("entity_stats", E("SELECT * FROM es", ENTITY_STATS_SQL))
def q_entity_stats(spark, sf):
    return profile.entity_stats(episodes(spark, sf))


@query("top_variable_entities", E("SELECT * FROM es ORDER BY std_cycle_length DESC, user_id LIMIT 15",
                                  ENTITY_STATS_SQL))
def q_top_variable_entities(spark, sf):
    # SRT3: the top 15 is the report itself
    return profile.top_k(profile.entity_stats(episodes(spark, sf)), "std_cycle_length", 15, "user_id")


def _pearson_sql(src: str, cols) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[:i]:
            parts.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
                         f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r FROM {src}")
    return "\nUNION ALL\n".join(parts)


@query("pearson_matrix", E(_pearson_sql("episodes", NUM)))
def q_pearson_matrix(spark, sf):
    return profile.pearson_matrix(episodes(spark, sf), NUM)


@query("pearson_lineitem", _pearson_sql("lineitem", LINE_NUM))
def q_pearson_lineitem(spark, sf):
    return profile.pearson_matrix(table(spark, sf, "lineitem"), LINE_NUM)


@query("pearson_comoments", _pearson_sql("lineitem", LINE_NUM + ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]))
def q_pearson_comoments(spark, sf):
    """AGG9 by merged co-moments: one pass, a plan of the same size for any number of columns."""
    columns = LINE_NUM + ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return profile.pearson_from_comoments(table(spark, sf, "lineitem"), columns)


def _hist_sql(src: str, cols, bins: int = 20, views=()) -> str:
    rng = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, MIN(CAST({c} AS DOUBLE)) AS mn, MAX(CAST({c} AS DOUBLE)) AS mx FROM {src}"
        for c in cols)
    vals = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS x FROM {src} WHERE {c} IS NOT NULL" for c in cols)
    fb = f"{float(bins)!r}e0"
    ctes = [
        f"r0 AS ({rng})",
        "r AS (SELECT column_name, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, "
        "CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM r0)",
        f"v AS ({vals})",
        f"c AS (SELECT v.column_name, CAST(LEAST(floor((x - lo) * {fb} / (hi - lo)), {bins - 1}) AS INT) AS bin, "
        "COUNT(*) AS n FROM v JOIN r ON v.column_name = r.column_name GROUP BY 1, 2)",
        f"g AS (SELECT r.*, CAST(b AS INT) AS bin FROM r CROSS JOIN range({bins}) t(b))",
    ]
    body = f"""
SELECT g.column_name, g.bin, lo + g.bin * ((hi - lo) / {fb}) AS bin_lo,
 lo + (g.bin + 1) * ((hi - lo) / {fb}) AS bin_hi, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM g LEFT JOIN c ON g.column_name = c.column_name AND g.bin = c.bin"""
    return with_views(body, *views, *ctes)


@query("histogram_20", _hist_sql("episodes", NUM, 20, (EPISODES_SQL,)))
def q_histogram_20(spark, sf):
    return profile.histogram(episodes(spark, sf), NUM, 20)


@query("histogram_lineitem", _hist_sql("lineitem", ["l_quantity", "l_extendedprice"]))
def q_histogram_lineitem(spark, sf):
    return profile.histogram(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], 20)


@query("discrete_histogram", E("""
SELECT n AS value, COUNT(*) AS n FROM (SELECT user_id, COUNT(*) AS n FROM episodes GROUP BY user_id) t GROUP BY n"""))
def q_discrete_histogram(spark, sf):
    return profile.discrete_histogram(profile.episodes_per_entity(episodes(spark, sf)), "n_episodes")


_BOX = ["cycle_length", "period_length", "stress_level", "bmi"]


def _box_sql(src: str, cols) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS column_name, q1, med, q3,
 MIN(CASE WHEN x >= q1 - 1.5e0 * (q3 - q1) THEN x END) AS whisker_lo,
 MAX(CASE WHEN x <= q3 + 1.5e0 * (q3 - q1) THEN x END) AS whisker_hi,
 CAST(COUNT(*) FILTER (WHERE x < q1 - 1.5e0 * (q3 - q1) OR x > q3 + 1.5e0 * (q3 - q1)) AS BIGINT) AS n_outliers
FROM (SELECT {x} AS x FROM {src} WHERE {c} IS NOT NULL) v CROSS JOIN
 (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS med, quantile_cont({x}, 0.75) AS q3 FROM {src}) q
GROUP BY q1, med, q3""")
    return "\nUNION ALL\n".join(parts)


@query("boxplot_stats", E(_box_sql("episodes", _BOX)))
def q_boxplot_stats(spark, sf):
    return profile.boxplot_stats(episodes(spark, sf), _BOX)


@query("boxplot_gap_lengths", with_views(_box_sql("gap_episodes", ["cycle_length"]), GAP_EPISODES_SQL))
def q_boxplot_gap_lengths(spark, sf):
    return profile.boxplot_stats(gap_episodes(spark, sf), ["cycle_length"])


@query("monthly_starts", E("""
SELECT strftime(cycle_start_date, '%Y-%m') AS year_month, COUNT(*) AS n_starts FROM episodes GROUP BY 1"""))
def q_monthly_starts(spark, sf):
    return profile.monthly_counts(episodes(spark, sf), "cycle_start_date")


@query("monthly_orders", """
SELECT strftime(o_orderdate, '%Y-%m') AS year_month, COUNT(*) AS n_starts FROM orders GROUP BY 1""")
def q_monthly_orders(spark, sf):
    return profile.monthly_counts(table(spark, sf, "orders"), "o_orderdate")


@query("date_span", E("""
SELECT 'episodes' AS source, MIN(cycle_start_date) AS first_date, MAX(cycle_start_date) AS last_date,
 CAST(datediff('day', MIN(cycle_start_date), MAX(cycle_start_date)) AS INT) AS span_days FROM episodes
UNION ALL
SELECT 'orders', CAST(MIN(o_orderdate) AS DATE), CAST(MAX(o_orderdate) AS DATE),
 CAST(datediff('day', CAST(MIN(o_orderdate) AS DATE), CAST(MAX(o_orderdate) AS DATE)) AS INT) FROM orders"""))
def q_date_span(spark, sf):
    a = profile.date_span(episodes(spark, sf), "cycle_start_date").withColumn("source", F.lit("episodes"))
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    b = profile.date_span(o, "d").withColumn("source", F.lit("orders"))
    return a.unionByName(b)


@query("calendar_parts", E("""
SELECT user_id, cycle_start_date, CAST(year(cycle_start_date) AS INT) AS cycle_year,
 CAST(month(cycle_start_date) AS INT) AS cycle_month, strftime(cycle_start_date, '%Y-%m') AS cycle_year_month,
 round(sin(2.0e0 * pi() * month(cycle_start_date) / 12.0e0), 9) AS month_sin,
 round(cos(2.0e0 * pi() * month(cycle_start_date) / 12.0e0), 9) AS month_cos
FROM episodes"""))
def q_calendar_parts(spark, sf):
    ep = episodes(spark, sf).select("user_id", "cycle_start_date")
    out = clean.cyclical_month(clean.calendar_parts(ep, "cycle_start_date"), "cycle_start_date")
    return out.withColumns({"month_sin": F.round("month_sin", 9), "month_cos": F.round("month_cos", 9)})


_STATIC = ["age", "bmi", "exercise_frequency", "diet", "stress_level", "sleep_hours", "symptoms"]


@query("static_feature_check", E("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, MAX(k) AS max_unique_values_per_user FROM "
    f"(SELECT user_id, COUNT(DISTINCT {c}) AS k FROM episodes GROUP BY user_id) t{i}"
    for i, c in enumerate(_STATIC))))
def q_static_feature_check(spark, sf):
    return profile.static_feature_check(episodes(spark, sf), _STATIC)


@query("low_record_entities", E("""
SELECT user_id, COUNT(*) AS n_episodes FROM episodes GROUP BY user_id HAVING COUNT(*) <= 3"""))
def q_low_record_entities(spark, sf):
    return profile.low_record_entities(episodes(spark, sf), 3)


@query("episode_head", E("""
SELECT * FROM episodes ORDER BY user_id, cycle_start_date LIMIT 5"""))
def q_episode_head(spark, sf):
    # SRT4: df.head() made reproducible by ordering on the keys
    return episodes(spark, sf).orderBy("user_id", "cycle_start_date").limit(5)


@query("gap_episodes", with_views("SELECT * FROM gap_episodes", GAP_EPISODES_SQL))
def q_gap_episodes(spark, sf):
    return gap_episodes(spark, sf).select("user_id", "o_orderkey", "cycle_start_date",
                                          "next_cycle_start_date", "cycle_length")


# --- GEN2/GEN3 on irregular rows: windows of 3 events per (user, day) -------------

EV_POS_SQL = """
WITH ev AS (SELECT event_id, ts, user_id, value, CAST(ts AS DATE) AS ev_date FROM events),
pos AS (SELECT *, row_number() OVER (PARTITION BY user_id, ev_date ORDER BY ts, event_id) - 1 AS p,
  COUNT(*) OVER (PARTITION BY user_id, ev_date) AS n FROM ev)"""


def _event_windows(spark, sf, L=3):
    ev = event_groups(spark, sf)
    return windows_by_position(ev.withColumn("__sec", F.date_trunc("second", "ts")), ["user_id", "ev_date"],
                               "__sec", ["ts", "event_id"], L, {"e": "event_id", "v": "value"})


@query("event_window_counts", EV_POS_SQL + """
SELECT CAST(3 AS INT) AS seq_length, COUNT(*) AS n_episodes,
 CAST(SUM(CASE WHEN n < 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_skipped,
 CAST(SUM(GREATEST(n - 2, 0)) AS BIGINT) AS n_windows_expected, CAST(SUM(GREATEST(n - 2, 0)) AS BIGINT) AS n_windows
FROM (SELECT DISTINCT user_id, ev_date, n FROM pos) g""")
def q_event_window_counts(spark, sf):
    """GEN3 / AGG16 on irregular groups: group sizes by a partial count; windows
    actually built by the skew-safe generator."""
    ev = event_groups(spark, sf)
    sizes = ev.groupBy("user_id", "ev_date").agg(F.count(F.lit(1)).alias("__n"))
    expected = sizes.agg(F.count(F.lit(1)).alias("n_episodes"),
                         F.sum((F.col("__n") < 3).cast("long")).alias("n_skipped"),
                         F.sum(F.greatest(F.col("__n") - 2, F.lit(0))).cast("long").alias("n_windows_expected"))
    built = _event_windows(spark, sf).agg(F.count(F.lit(1)).alias("n_windows"))
    return expected.crossJoin(built).select(F.lit(3).alias("seq_length"), "n_episodes", "n_skipped",
                                            "n_windows_expected", "n_windows")


@query("event_window_digest", EV_POS_SQL + """
SELECT a.user_id, a.ev_date, CAST(3 AS INT) AS seq_length, CAST(a.p AS INT) AS window_start,
 MIN(b.event_id) FILTER (WHERE b.p = a.p) AS first_event_id, MAX(b.event_id) FILTER (WHERE b.p = a.p + 2) AS last_event_id,
 round(SUM(b.value), 6) AS sum_value
FROM pos a JOIN pos b ON a.user_id = b.user_id AND a.ev_date = b.ev_date AND b.p BETWEEN a.p AND a.p + 2
WHERE a.p <= a.n - 3 GROUP BY a.user_id, a.ev_date, a.p""")
def q_event_window_digest(spark, sf):
    w = _event_windows(spark, sf)
    return w.select("user_id", "ev_date", "seq_length", "window_start",
                    F.col("win")[0]["e"].alias("first_event_id"),
                    F.element_at("win", -1)["e"].alias("last_event_id"),
                    F.round(F.aggregate(F.transform("win", lambda r: r["v"]), F.lit(0.0),
                                        lambda a, v: a + v), 6).alias("sum_value"))
