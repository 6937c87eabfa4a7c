"""Catalog part 7 - stored stages and feature tensors: split panels, membership, scaler, contract and windows
written to the shared folder, read back and compared by value (all 18 features as float32)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, scale, sequences, split
from ..operators.clean import parse_date
from ..sources import io
from ..sources.tables import episodes, table
from ..spec import DEFAULT as S
from ..spec import SPLIT_RATIOS, SPLIT_SEED
from .pipelines import day_partitions, days_of, split_and_scale, split_daily, window_source
from .q_eval import E as EVAL
from .q_eval import METRICS_SQL, predictions
from .q_io import _scratch
from .q_prep import EP_SQL, P
from .registry import query

L = 21
_KEYS = ["split", "user_id", "cycle_start_date"]


@query("splits_roundtrip", P(f"SELECT {', '.join(S.daily_columns)}, split FROM dsplit WHERE split IN ('val', 'test')"))
def q_splits_roundtrip(spark, sf):
    """SNK2 -> SRC3: the split panel in folders by split; reading two splits prunes the third."""
    path = _scratch(spark, "splits")
    io.write_splits(split_daily(episodes(spark, sf)).select(*S.daily_columns, "split"), path)
    return io.read_splits(spark, path, ["val", "test"])


@query("membership_roundtrip", P(f"""
SELECT user_id, split, {SPLIT_RATIOS[0]!r}e0 AS train_ratio, {SPLIT_RATIOS[1]!r}e0 AS val_ratio,
 {SPLIT_RATIOS[2]!r}e0 AS test_ratio, CAST({SPLIT_SEED} AS INT) AS random_state FROM membership"""))
def q_membership_roundtrip(spark, sf):
    """SNK3: entity -> split with the split's parameters."""
    path = _scratch(spark, "membership")
    io.write_membership(split.split_membership(episodes(spark, sf)), path, SPLIT_RATIOS, SPLIT_SEED)
    return spark.read.parquet(path)


@query("scaler_roundtrip", P("SELECT user_id, cycle_start_date, split, day_in_cycle AS day_in_cycle_raw, "
                             + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in S.scale_columns)
                             + " FROM dsplit"))
def q_scaler_roundtrip(spark, sf):
    """SNK4 + SCL3: scaled values back to their units with the stored parameters."""
    path = _scratch(spark, "scaler")
    scaled, params = split_and_scale(episodes(spark, sf))
    io.write_scaler(params, path)
    raw = scale.inverse_minmax(scaled, spark.read.parquet(path))
    return raw.select("user_id", "cycle_start_date", "split", "day_in_cycle_raw",
                      *[(F.round(c, 6) + 0.0).alias(c) for c in S.scale_columns])


@query("contract_roundtrip", P("\nUNION ALL\n".join(
    f"SELECT 'scaled' AS stage, '{c}' AS column_name, {c}__min AS data_min, {c}__max AS data_max, "
    f"{S.input_features.index(c)} AS feature_position, (SELECT COUNT(*) FROM membership) AS n_entities FROM params"
    for c in S.scale_columns)))
def q_contract_roundtrip(spark, sf):
    """SNK5 -> SRC4: the contract of the encoded panel, updated with split and scaler sections."""
    path = _scratch(spark, "contract")
    ep = episodes(spark, sf)
    io.write_contract(spark, path, stage="encoded")
    _, params = split_and_scale(ep)
    fitted = [r.asDict() for r in scale.params_long(params).collect()]  # one row per scaled column
    n = ep.select("user_id").distinct().count()
    io.update_contract(spark, path, {"stage": "scaled", "split": {"n_entities": n, "random_state": SPLIT_SEED},
                                     "scaler": {r.pop("column_name"): r for r in fitted}})
    doc = io.read_contract(spark, path)
    rows = [(doc["stage"], c, p["data_min"], p["data_max"], doc["input_features"].index(c),
             doc["split"]["n_entities"]) for c, p in doc["scaler"].items()]
    return spark.createDataFrame(rows, "stage string, column_name string, data_min double, data_max double, "
                                       "feature_position int, n_entities long")


# --- window tensors ----------------------------------------------------------

TENSOR_SQL = P(f"""
SELECT split, user_id, cycle_start_date, CAST({L} AS INT) AS seq_length, CAST(MAX(n) - {L - 1} AS BIGINT) AS n_windows,
 CAST(SUM(w * phase_label) AS BIGINT) AS y_phase, CAST(SUM(w * days_until_next_cycle) AS DOUBLE) AS y_reg,
 {', '.join(f'round(SUM(w * CAST(CAST({c} AS FLOAT) AS DOUBLE)), 4) AS x_{c}' for c in S.input_features)}
FROM (SELECT *, list_sum([(p - s + 1) * (s + 1) FOR s IN range(GREATEST(0, p - {L - 1}), LEAST(p, n - {L}) + 1)]) AS w
      FROM spos WHERE n >= {L}) t
GROUP BY split, user_id, cycle_start_date""", """
spos AS (SELECT *,
  row_number() OVER (PARTITION BY user_id, cycle_start_date ORDER BY day_in_cycle_raw) - 1 AS p,
  COUNT(*) OVER (PARTITION BY user_id, cycle_start_date) AS n FROM scaled)""")


def tensor_digest(w):
    """Per episode: each tensor cell times (step + 1) * (window start + 1), summed per feature and target. The
    weights tell steps and windows apart, so a swapped, shifted or missing cell changes the sum."""
    # steps are exploded and cells looked up: no row per cell is built with the features as a struct
    cells = w.select(*_KEYS, "seq_length", "window_start", "X", "y_phase", "y_reg",
                     F.explode(F.sequence(F.lit(0), F.size("X") - 1)).alias("t"))
    t, weight = F.col("t"), ((F.col("t") + 1) * (F.col("window_start") + 1)).cast("long")
    cells = cells.select(*_KEYS, "seq_length", t, weight.alias("w"), F.col("X")[t].alias("x"),
                         F.col("y_phase")[t].alias("y"), F.col("y_reg")[t].cast("double").alias("r"))
    return cells.groupBy(*_KEYS, "seq_length").agg(
        F.sum((t == 0).cast("long")).alias("n_windows"),
        F.sum(F.col("w") * F.col("y")).alias("y_phase"),
        F.sum(F.col("w") * F.col("r")).alias("y_reg"),
        *[F.round(F.sum(F.col("w") * F.col("x")[i].cast("double")), 4).alias(f"x_{c}")
          for i, c in enumerate(S.input_features)])


@query("window_tensor_digest", TENSOR_SQL)
def q_window_tensor_digest(spark, sf):
    """PRJ14, PRJ17, GEN2: the tensors built straight from the episode rows."""
    return tensor_digest(sequences.window_arrays(sequences.windows(window_source(episodes(spark, sf)), L)))


@query("windows_from_stored_splits", TENSOR_SQL)
def q_windows_from_stored_splits(spark, sf):
    """SNK2 -> SRC3 -> GEN2 by row count -> SNK6 -> SRC5 with the whole X."""
    panel, out = _scratch(spark, "scaled-splits"), _scratch(spark, "tensors")
    scaled, _ = split_and_scale(episodes(spark, sf))
    io.write_splits(scaled, panel)
    back = sequences.require_features(io.read_splits(spark, panel))
    # the days of an episode meet in partitions sized for them, and the windows are cut and sorted there
    back = back.repartition(day_partitions(back.count(), spark), *S.episode_keys)
    rows = sequences.episode_rows(back, order_col="day_in_cycle_raw")
    io.write_windows(sequences.window_arrays(sequences.windows(rows, L)), out)
    return tensor_digest(io.read_windows(spark, out, L))


@query("windows_from_buckets", TENSOR_SQL)
def q_windows_from_buckets(spark, sf):
    """SNK2 -> GEN2 on a bucketed panel: the day rows of an episode meet without an exchange."""
    path = _scratch(spark, "buckets")
    ep = episodes(spark, sf)
    scaled, _ = split_and_scale(ep)
    name, buckets = f"panel_{path[-32:]}", max(8, day_partitions(days_of(ep), spark))  # a task sorts and collects a bucket
    order = [S.entity, S.start, "day_in_cycle_raw"]
    try:
        back = io.write_bucketed(scaled, name, path, buckets, order=order)
        rows = sequences.episode_rows(sequences.require_features(back), order_col="day_in_cycle_raw", keys=[*S.episode_keys, "split"])
        # written here, as the table's name goes
        out = _scratch(spark, "bucket-tensors")
        io.write_windows(sequences.window_arrays(sequences.windows(rows, L)), out)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return tensor_digest(io.read_windows(spark, out, L))


@query("window_metadata", P(f"""
SELECT split, CAST(l AS INT) AS seq_length, CAST(SUM(GREATEST(n - l + 1, 0)) AS BIGINT) AS n_windows,
 CAST({len(S.input_features)} AS INT) AS n_features, '{S.label},{S.countdown}' AS targets
FROM ep CROSS JOIN (SELECT * FROM (VALUES (14), (21)) v(l)) t GROUP BY split, l""", EP_SQL))
def q_window_metadata(spark, sf):
    """SNK7: windows, steps, features (measured on the tensors) and targets, written as JSON and read back."""
    path = _scratch(spark, "window-metadata")
    w = sequences.window_arrays(sequences.windows(window_source(episodes(spark, sf)), [14, 21]))
    io.write_window_metadata(io.window_metadata(w), path)
    meta = spark.read.json(path)
    return meta.select("split", F.col("seq_length").cast("int"), "n_windows", F.col("n_features").cast("int"),
                       F.array_join("targets", ",").alias("targets"))


# --- small operators that had no query ---------------------------------------------

@query("argmax_label", P("""
SELECT user_id, cycle_start_date, day_in_cycle, CAST(list_position(p, list_max(p)) - 1 AS INT) AS label
FROM (SELECT *, [day_in_cycle % 3, cycle_length % 3, period_length % 3, 1] AS p FROM dsplit) t"""))
def q_argmax_label(spark, sf):
    """EVL1 on score arrays with ties: the first maximum wins."""
    sp = split_daily(episodes(spark, sf))
    scores = F.array(F.col(S.day) % 3, F.col(S.length) % 3, F.col(S.prefix) % 3, F.lit(1))
    return sp.select("user_id", "cycle_start_date", S.day, evaluate.argmax_label(scores).alias("label"))


# text forms of one date, chosen by order key
_DATE_FORMS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss.SSS", "yyyyMMdd", "yyyy-M-d",
               "MMM d, yyyy", "MM/dd/yyyy")


@query("parse_dates_formats", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders")
def q_parse_dates_formats(spark, sf):
    """PRJ2: the order dates as text in seven forms, all read back."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    text = F.coalesce(*[F.when(F.col("o_orderkey") % len(_DATE_FORMS) == i, F.date_format("ts", f))
                        for i, f in enumerate(_DATE_FORMS)])
    return o.select("o_orderkey", parse_date(text).alias("order_date"))


@query("report_rows_roundtrip", EVAL(f"SELECT split AS experiment, metric, class_name, value FROM ({METRICS_SQL}) m"))
def q_report_rows_roundtrip(spark, sf):
    """SNK8 -> SRC6 with many rows in one file."""
    path = _scratch(spark, "report-rows")
    rows = evaluate.metrics_report(predictions(spark, sf), ["split"], "w").withColumnRenamed("split", "experiment")
    io.write_report(rows.coalesce(1), path)
    return io.read_reports(spark, path).select("experiment", "metric", "class_name", "value")
