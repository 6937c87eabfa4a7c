"""Driver tables and the panel views built on them (FIXTURES.md §2-4).

The reference ships no data; its episode table is re-created from ``orders``
and ``customer`` so every query's work grows with those tables.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import exclusive_running, next_on_calendar
from ..session import materialize

EPOCH = "2023-03-20"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def episodes(spark: SparkSession, sf_dir: str, materialized: bool | None = None) -> DataFrame:
    """One episode per order, laid end to end per customer from 2023-03-20.

    The view is a join plus a running sum; every consumer branch of a plan
    would re-evaluate it, so by default it is written once to the shared
    checkpoint folder (a derived table, like the reference's episode CSV)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                              "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    b = o.select(
        F.col("o_custkey").cast("long").alias("user_id"), "o_orderkey", "o_orderdate", "o_orderpriority",
        (F.lit(25) + (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 26).cast("int")
        .alias("cycle_length"),
        (F.lit(3) + F.col("o_orderkey") % 5).cast("int").alias("period_length"),
        F.to_date("o_orderdate").alias("__day"),
    )
    # the running sum reads its input twice, so it runs on orders alone: an order without a customer only moves
    # the offsets of its own key, whose rows all leave with the join below
    s = exclusive_running(b, "user_id", "__day", ["o_orderdate", "o_orderkey"],
                          {"off": "cycle_length"}, counts=False)
    s = s.join(c, s.user_id == c.c_custkey)
    off = F.coalesce(F.col("off_sum"), F.lit(0)).cast("int")
    uid = F.col("user_id")
    out = s.select(
        uid,
        (F.lit(18) + uid % 28).cast("int").alias("age"),
        (F.lit(18.0) + (uid % 120) / F.lit(10.0)).alias("bmi"),
        (F.lit(1) + uid % 5).cast("int").alias("stress_level"),
        F.when(F.col("c_nationkey") % 3 == 0, "Low").when(F.col("c_nationkey") % 3 == 1, "Moderate")
        .otherwise("High").alias("exercise_frequency"),
        (F.lit(5.0) + (uid % 40) / F.lit(10.0)).alias("sleep_hours"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "Balanced")
        .when(F.col("c_mktsegment") == "BUILDING", "High Sugar")
        .when(F.col("c_mktsegment") == "FURNITURE", "Low Carb")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "Vegetarian")
        .otherwise("Balanced").alias("diet"),
        F.date_add(F.lit(EPOCH).cast("date"), off).alias("cycle_start_date"),
        "cycle_length", "period_length",
        F.date_add(F.lit(EPOCH).cast("date"), off + F.col("cycle_length"))
        .alias("next_cycle_start_date"),
        F.when(F.substring("o_orderpriority", 1, 1) == "1", "Bloating")
        .when(F.substring("o_orderpriority", 1, 1) == "2", "Cramps")
        .when(F.substring("o_orderpriority", 1, 1) == "3", "Fatigue")
        .when(F.substring("o_orderpriority", 1, 1) == "4", "Headache")
        .otherwise("Mood Swings").alias("symptoms"),
    )
    if materialized is None:
        materialized = os.environ.get("PANELSPARK_MATERIALIZE_VIEWS", "1") == "1"
    return materialize(out) if materialized else out


def episodes_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same rows with string dates and seeded faults (FIXTURES.md §3)."""
    e = episodes(spark, sf_dir)
    k = F.col("user_id") * 1000 + F.datediff("cycle_start_date", F.lit(EPOCH).cast("date"))
    e = e.withColumn("__k", k)

    def fault(m):
        return F.col("__k") % m == 0

    return e.select(
        "user_id", "age", "bmi", "stress_level",
        F.when(fault(41), "Extreme").otherwise(F.col("exercise_frequency")).alias("exercise_frequency"),
        "sleep_hours",
        F.when(fault(53), "Keto").when(fault(59), F.lit(None).cast("string"))
        .otherwise(F.col("diet")).alias("diet"),
        F.when(fault(97), "not-a-date").otherwise(F.col("cycle_start_date").cast("string"))
        .alias("cycle_start_date"),
        F.when(fault(67), F.col("period_length")).otherwise(F.col("cycle_length")).alias("cycle_length"),
        F.when(fault(71), F.lit(0)).otherwise(F.col("period_length")).alias("period_length"),
        F.when(fault(101), F.lit(None).cast("string"))
        .otherwise(F.col("next_cycle_start_date").cast("string")).alias("next_cycle_start_date"),
        F.when(fault(61), "Cramps, Bloating").otherwise(F.col("symptoms")).alias("symptoms"),
    )


def episodes_with_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``episodes`` plus a second copy of the rows of every 97th entity (DQ2, AGG4)."""
    e = episodes(spark, sf_dir)
    return e.unionByName(e.filter(F.col("user_id") % 97 == 0))


def gap_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular episodes: start = order date, next = the customer's next order date."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("long").alias("user_id"), "o_orderkey",
        F.to_date("o_orderdate").alias("cycle_start_date"))
    g = next_on_calendar(o, "user_id", "cycle_start_date", ["o_orderkey"], "next_cycle_start_date")
    return g.withColumn("cycle_length",
                        F.datediff("next_cycle_start_date", "cycle_start_date").cast("int"))


def event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events grouped by (user, calendar day of ts); order by ts, event_id."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    return ev.withColumn("ev_date", F.to_date("ts"))


# ---------------------------------------------------------------------------
# The same views as SQL, valid in DuckDB, for the oracle.
# ---------------------------------------------------------------------------

EPISODES_SQL = """
episodes AS (
 WITH b AS (
  SELECT CAST(o.o_custkey AS BIGINT) AS user_id, o.o_orderkey, o.o_orderdate, o.o_orderpriority,
   c.c_nationkey, c.c_mktsegment,
   CAST(25 + (o.o_orderkey * 7 + o.o_custkey) % 26 AS INT) AS cycle_length,
   CAST(3 + o.o_orderkey % 5 AS INT) AS period_length
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
 s AS (SELECT *, CAST(COALESCE(SUM(cycle_length) OVER (PARTITION BY user_id
   ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS off
   FROM b)
 SELECT user_id, CAST(18 + user_id % 28 AS INT) AS age, 18.0e0 + (user_id % 120) / 10.0e0 AS bmi,
  CAST(1 + user_id % 5 AS INT) AS stress_level,
  CASE c_nationkey % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Moderate' ELSE 'High' END AS exercise_frequency,
  5.0e0 + (user_id % 40) / 10.0e0 AS sleep_hours,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Balanced' WHEN 'BUILDING' THEN 'High Sugar'
   WHEN 'FURNITURE' THEN 'Low Carb' WHEN 'HOUSEHOLD' THEN 'Vegetarian' ELSE 'Balanced' END AS diet,
  CAST(DATE '2023-03-20' + off AS DATE) AS cycle_start_date, cycle_length, period_length,
  CAST(DATE '2023-03-20' + (off + cycle_length) AS DATE) AS next_cycle_start_date,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Bloating' WHEN '2' THEN 'Cramps'
   WHEN '3' THEN 'Fatigue' WHEN '4' THEN 'Headache' ELSE 'Mood Swings' END AS symptoms
 FROM s)"""

EPISODES_DIRTY_SQL = """
episodes_dirty AS (
 SELECT user_id, age, bmi, stress_level,
  CASE WHEN k % 41 = 0 THEN 'Extreme' ELSE exercise_frequency END AS exercise_frequency,
  sleep_hours,
  CASE WHEN k % 53 = 0 THEN 'Keto' WHEN k % 59 = 0 THEN NULL ELSE diet END AS diet,
  CASE WHEN k % 97 = 0 THEN 'not-a-date' ELSE CAST(cycle_start_date AS VARCHAR) END AS cycle_start_date,
  CASE WHEN k % 67 = 0 THEN period_length ELSE cycle_length END AS cycle_length,
  CASE WHEN k % 71 = 0 THEN 0 ELSE period_length END AS period_length,
  CASE WHEN k % 101 = 0 THEN NULL ELSE CAST(next_cycle_start_date AS VARCHAR) END AS next_cycle_start_date,
  CASE WHEN k % 61 = 0 THEN 'Cramps, Bloating' ELSE symptoms END AS symptoms
 FROM (SELECT e.*, user_id * 1000 + datediff('day', DATE '2023-03-20', cycle_start_date) AS k
       FROM episodes e) t)"""

GAP_EPISODES_SQL = """
gap_episodes AS (
 SELECT user_id, o_orderkey, cycle_start_date, next_cycle_start_date,
  CAST(datediff('day', cycle_start_date, next_cycle_start_date) AS INT) AS cycle_length
 FROM (SELECT CAST(o_custkey AS BIGINT) AS user_id, o_orderkey, CAST(o_orderdate AS DATE) AS cycle_start_date,
   LEAD(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)
     AS next_cycle_start_date
  FROM orders) t)"""


def with_views(body: str, *views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + body
