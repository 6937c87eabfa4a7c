"""Catalog part 8 - experiment reports that SQL can follow: the history forecast scored on windows of 14 and 21 days
(two experiments), with rising confidence as its epochs, written as reports and histories and read back."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import evaluate
from ..sources import io
from ..spec import LOSS_WEIGHTS
from .q_eval import CONF_SQL, REG_SQL, REP_SQL, SUMM_SQL, pred_sql, predictions
from .q_io import _scratch
from .q_prep import P
from .registry import query

RUNS = {14: "history_seq14", 21: "history_seq21"}
CONFIDENCES = (0.4, 0.7, 0.9, 0.8, 0.99)
# the key of each curve in the two runs' histories: a common and an older name
ACC_KEY = {14: "phase_output_accuracy", 21: "acc"}
MAE_KEY = {14: "regression_output_mean_absolute_error", 21: "mae"}

# the scoring views group by ``split``: here it holds run and split
RUNS_SQL = ", ".join(pred_sql(n, f"pred{n}").strip() for n in RUNS) + ", pred AS (" + " UNION ALL ".join(
    f"SELECT * REPLACE ('{name}/' || split AS split) FROM pred{n}" for n, name in RUNS.items()) + ")"
EPOCH_SQL = """
epochs AS (SELECT split_part(split, '/', 1) AS experiment, split_part(split, '/', 2) AS part, e.epoch,
  {w0!r} * SUM(w * -ln(CASE WHEN pred_label = y_phase THEN c ELSE (1.0e0 - c) / 3.0e0 END)) / SUM(w)
   + {w1!r} * SUM(w * abs(pred_reg - y_reg)) / SUM(w) AS loss,
  SUM(CASE WHEN pred_label = y_phase THEN w ELSE 0 END) * 1.0e0 / SUM(w) AS acc,
  SUM(w * abs(pred_reg - y_reg)) / SUM(w) AS mae
 FROM pred CROSS JOIN (SELECT * FROM (VALUES {values}) v(epoch, c)) e
 WHERE split NOT LIKE '%/test' GROUP BY split, e.epoch)""".format(
    w0=LOSS_WEIGHTS[0], w1=LOSS_WEIGHTS[1],
    values=", ".join(f"(CAST({i} AS INT), {c!r}e0)" for i, c in enumerate(CONFIDENCES, 1)))


def R(body: str) -> str:
    return P(body, RUNS_SQL, CONF_SQL, REP_SQL, SUMM_SQL, REG_SQL, EPOCH_SQL)


def _runs(spark, sf):
    """The predictions of both runs as one table with an ``experiment`` column."""
    a, b = (predictions(spark, sf, n).withColumn("experiment", F.lit(name)) for n, name in RUNS.items())
    return a.unionByName(b)


def _write_reports(spark, sf) -> str:
    path = _scratch(spark, "reports")
    nested = evaluate.metrics_nested(evaluate.metrics_report(_runs(spark, sf), ["experiment", "split"], "w"),
                                     ["experiment", "split"])
    fields = F.struct(*[c for c in nested.columns if c not in ("experiment", "split")])
    head = nested.groupBy("experiment").agg(*[
        F.first(F.when(F.col("split") == s, fields), ignorenulls=True).alias(k)
        for s, k in (("val", "validation"), ("test", "test"))])
    head = head.withColumn("experiment_config", F.struct(F.lit("none").alias("optimizer_name")))
    io.write_report(head, path)
    return path


def _write_histories(spark, sf) -> str:
    """Train and validation loss, accuracy and MAE per epoch (= confidence), from one cube of the predictions."""
    base = _scratch(spark, "histories")
    cube = evaluate.prediction_cube(_runs(spark, sf).filter("split <> 'test'"), "y_phase", "pred_label",
                                    ["experiment", "split"], "w", "y_reg", "pred_reg")
    epochs = F.explode(F.array(*[F.struct(F.lit(i).alias("epoch"), F.lit(c).alias("c"))
                                 for i, c in enumerate(CONFIDENCES, 1)]))
    hit = F.col("true_label") == F.col("pred_label")
    ce = -F.log(F.when(hit, F.col("e.c")).otherwise((F.lit(1.0) - F.col("e.c")) / F.lit(3.0)))
    per = cube.withColumn("e", epochs).groupBy("experiment", "split", F.col("e.epoch").alias("epoch")).agg(
        (F.sum(F.col("n") * ce) / F.sum("n")).alias("ce"), (F.sum("sae") / F.sum("n")).alias("mae"),
        (F.sum(F.when(hit, F.col("n")).otherwise(0.0)) / F.sum("n")).alias("acc"))
    per = per.withColumn("loss", F.lit(LOSS_WEIGHTS[0]) * F.col("ce") + F.lit(LOSS_WEIGHTS[1]) * F.col("mae"))

    def series(part, c):  # one value per epoch, in epoch order
        return F.array_sort(F.collect_list(F.when(F.col("split") == part, F.struct("epoch", c))))[c]

    wide = per.groupBy("experiment").agg(*[series(p, c).alias(f"{pre}{c}") for p, pre in (("train", ""), ("val", "val_"))
                                           for c in ("loss", "acc", "mae")])
    for n, name in RUNS.items():
        keys = {"loss": "loss", "acc": ACC_KEY[n], "mae": MAE_KEY[n]}
        run = wide.filter(F.col("experiment") == name).select("experiment", *[
            F.col(pre + c).alias(pre + k) for pre in ("", "val_") for c, k in keys.items()])
        io.write_report(run, os.path.join(base, name))
    return base


def _history(spark, sf):
    base = _write_histories(spark, sf)
    parts = [evaluate.history_long(io.read_histories(spark, os.path.join(base, name))) for name in RUNS.values()]
    return parts[0].unionByName(parts[1])


@query("report_leaderboard", R("""
SELECT split_part(split, '/', 1) AS experiment, 'none' AS optimizer, round(accuracy, 9) AS accuracy,
 round(macro_f1, 9) AS macro_f1, round(weighted_f1, 9) AS weighted_f1, round(mae, 9) AS mae_days,
 round(rmse, 9) AS rmse_days FROM summ JOIN reg USING (split) WHERE split LIKE '%/test'"""))
def q_report_leaderboard(spark, sf):
    """SNK8 -> SRC6 -> EVL9."""
    return evaluate.leaderboard(io.read_reports(spark, _write_reports(spark, sf)))


def _long_sql() -> str:
    parts = []
    for n, name in RUNS.items():
        for col, key in (("loss", "loss"), ("acc", ACC_KEY[n]), ("mae", MAE_KEY[n])):
            for part, pre in (("train", ""), ("val", "val_")):
                parts.append(f"SELECT experiment, epoch, '{pre}{key}' AS metric, round({col}, 8) AS value FROM epochs "
                             f"WHERE experiment = '{name}' AND part = '{part}'")
    return "\nUNION ALL\n".join(parts)


@query("report_history_long", R(_long_sql()))
def q_report_history_long(spark, sf):
    """SNK8 -> SRC6 -> GEN6."""
    return _history(spark, sf).withColumn("value", F.round("value", 8))


@query("report_learning_curves", R("""
SELECT t.experiment, c.curve, t.epoch,
 round(CASE c.curve WHEN 'loss' THEN t.loss WHEN 'phase_accuracy' THEN t.acc ELSE t.mae END, 8) AS train,
 round(CASE c.curve WHEN 'loss' THEN v.loss WHEN 'phase_accuracy' THEN v.acc ELSE v.mae END, 8) AS val
FROM (SELECT * FROM epochs WHERE part = 'train') t JOIN (SELECT * FROM epochs WHERE part = 'val') v
 ON t.experiment = v.experiment AND t.epoch = v.epoch
CROSS JOIN (SELECT * FROM (VALUES ('loss'), ('phase_accuracy'), ('regression_mae')) x(curve)) c"""))
def q_report_learning_curves(spark, sf):
    """EVL10: the curves under whichever key each run used."""
    c = evaluate.learning_curves(_history(spark, sf))
    return c.select("experiment", "curve", "epoch", F.round("train", 8).alias("train"), F.round("val", 8).alias("val"))


@query("report_best_epoch", R("""
SELECT experiment, epoch AS best_epoch, round(loss, 8) AS best_value, n AS epochs_run FROM (
 SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY loss, epoch) AS r,
  CAST(COUNT(*) OVER (PARTITION BY experiment) AS INT) AS n FROM epochs WHERE part = 'val') t WHERE r = 1"""))
def q_report_best_epoch(spark, sf):
    """WIN7 on the validation loss."""
    return evaluate.best_epoch(_history(spark, sf)).withColumn("best_value", F.round("best_value", 8))
