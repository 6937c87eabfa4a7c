"""Catalog part 5 - sources and sinks end to end: derived tables are written to the
session's shared folder and read back through the readers, so the driver's gate
checks SRC1/SRC2/SRC5 and SNK1/SNK6 on whole tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import sequences
from ..session import ensure_checkpoint_dir
from ..sources import io
from ..sources.tables import EPISODES_SQL, episodes, with_views
from .pipelines import daily_for_sink, window_source
from .q_builder import D, DAILY_COLUMNS_SQL
from .q_prep import _digest_sql
from .registry import query

# The raw CSV headers before normalisation.
RAW_HEADERS = {
    "user_id": "User ID", "age": "Age", "bmi": "BMI", "stress_level": "Stress Level",
    "exercise_frequency": "Exercise Frequency", "sleep_hours": "Sleep Hours", "diet": "Diet",
    "cycle_start_date": "Cycle Start Date", "cycle_length": "Cycle Length",
    "period_length": "Period Length", "next_cycle_start_date": "Next Cycle Start Date",
    "symptoms": "Symptoms",
}


def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the session."""
    return os.path.join(ensure_checkpoint_dir(spark), "panelspark-io", f"{name}-{uuid.uuid4().hex}")


@query("episodes_csv_roundtrip", with_views("SELECT * FROM episodes", EPISODES_SQL))
def q_episodes_csv_roundtrip(spark, sf):
    """SNK (CSV with the raw headers) -> SRC1: header normalisation, typed casts, dates."""
    path = _scratch(spark, "episodes-csv")
    ep = episodes(spark, sf)
    ep.select(*[F.col(c).cast("string").alias(RAW_HEADERS[c]) for c in RAW_HEADERS]) \
        .write.option("header", True).csv(path)
    back = io.read_episodes_csv(spark, path)
    return back.select(*RAW_HEADERS)


@query("daily_panel_roundtrip", D(f"SELECT {DAILY_COLUMNS_SQL} FROM daily"))
def q_daily_panel_roundtrip(spark, sf):
    """SNK1 -> SRC2: the daily panel in the sink column order, read back typed."""
    path = _scratch(spark, "daily")
    io.write_daily(daily_for_sink(episodes(spark, sf)), path)
    return io.read_daily(spark, path)


@query("windows_roundtrip_21", _digest_sql(21))
def q_windows_roundtrip_21(spark, sf):
    """SNK6 -> SRC5: whole windows of L = 14 and 21 (day, all features, label, countdown) written partitioned by
    (seq_length, split); reading L = 21 prunes the other length's files.  Compared through the digest; the features,
    which it lacks, by a hash written beside them: a window whose features come back otherwise fails the job."""
    path = _scratch(spark, "windows")
    w = sequences.windows(window_source(episodes(spark, sf)), [14, 21])
    w = sequences.window_arrays(w.withColumn("day", F.col("win.o"))).withColumn("x_hash", F.xxhash64("X"))
    io.write_windows(w, path)
    back = io.read_windows(spark, path, 21)
    differs = F.raise_error(F.lit("the features of a window read back are not those written")).cast("int")
    length = F.when(F.col("x_hash") == F.xxhash64("X"), F.col("seq_length")).otherwise(differs)
    return sequences.window_digest(back.withColumn("seq_length", length)).select(
        "split", "user_id", "cycle_start_date", "seq_length", "window_start", "first_day", "last_day", "sum_label",
        "sum_countdown", "labels_md5")


@query("experiment_reports")
def q_experiment_reports(spark, sf):
    """SNK8 -> SRC6 -> EVL9 / GEN6 / EVL10 / WIN7 on experiments fitted on the tables:
    the FCT2 classifier + FCT3 regressor (the two heads) under two settings, each scored on val/test (EVL8, nested
    layout) and written with its training history as JSON; the reports are read
    back into a leaderboard joined with each run's best iteration."""
    from ..operators import evaluate, forecast
    from .pipelines import countdown_moments, scaled_days, scaled_episodes

    ep, params = scaled_episodes(episodes(spark, sf))
    scaled = scaled_days(ep, params)
    base = _scratch(spark, "experiments")
    for name, iters in (("lr_iter10", 10), ("lr_iter25", 25)):
        model = forecast.fit_phase_classifier(scaled, max_iter=iters)
        reg = forecast.fit_countdown_regressor(countdown_moments(ep, params), max_iter=iters, weight="weight")
        scored = forecast.score_countdown_regressor(reg, forecast.score_phase_classifier(model, scaled))
        pred = scored.filter(F.col("split") != "train") \
            .select("split", F.col("phase_label").alias("y_phase"), "pred_label", "probs",
                    F.col("days_until_next_cycle").cast("double").alias("y_reg"), "pred_reg")
        nested = evaluate.metrics_nested(evaluate.metrics_report(pred))
        head = nested.groupBy().agg(*[
            F.first(F.when(F.col("split") == s, F.struct(*[c for c in nested.columns if c != "split"])),
                    ignorenulls=True).alias(k) for s, k in (("val", "validation"), ("test", "test"))])
        head = head.select(F.lit(name).alias("experiment"), "validation", "test",
                           F.struct(F.lit("multinomial_lr").alias("model"), F.lit(iters).alias("max_iter"),
                                    F.lit("lbfgs").alias("optimizer_name")).alias("experiment_config"))
        io.write_report(head, os.path.join(base, "metrics"), mode="append")
        # the fit's per-iteration objective (bounded by max_iter): the training history
        loss = [float(v) for v in model.summary.objectiveHistory]
        hist = spark.createDataFrame([(name, loss)], "experiment string, loss array<double>")
        io.write_report(hist, os.path.join(base, "history"), mode="append")
    reports = io.read_reports(spark, os.path.join(base, "metrics"))
    board = evaluate.leaderboard(reports, split="test")
    hist_long = evaluate.history_long(io.read_histories(spark, os.path.join(base, "history")))
    best = evaluate.best_epoch(hist_long, metric="loss")
    curves = evaluate.learning_curves(hist_long).groupBy("experiment").agg(
        F.count(F.lit(1)).alias("n_curve_points"))
    return board.join(best, "experiment").join(curves, "experiment")
