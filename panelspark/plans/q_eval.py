"""Catalog part 4 - entry C: forecasts and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, forecast, sequences
from ..sources.tables import episodes
from ..spec import DEFAULT as S
from .pipelines import countdown_moments, scaled_days, scaled_episodes, split_and_scale, split_daily, window_source
from .q_prep import P
from .registry import query

L = 21  # window length of the reference's final run


def pred_sql(n: int, name: str = "pred") -> str:
    """The history forecast of every day, weighted with the number of windows of ``n`` days that hold the day."""
    return f"""
{name} AS (SELECT split, user_id, cycle_start_date, day_in_cycle, phase_label AS y_phase,
  CAST(days_until_next_cycle AS DOUBLE) AS y_reg,
  CAST(CASE WHEN day_in_cycle < ph THEN 0 WHEN day_in_cycle < ch - 14 THEN 1 WHEN day_in_cycle = ch - 14 THEN 2
   ELSE 3 END AS INT) AS pred_label,
  GREATEST(hist_mean_cycle - day_in_cycle, 0.0e0) AS pred_reg,
  CAST(GREATEST(LEAST(day_in_cycle, cycle_length - {n}) - GREATEST(0, day_in_cycle - {n - 1}) + 1, 0) AS BIGINT) AS w
 FROM (SELECT *, CAST(round_even(hist_mean_cycle, 0) AS INT) AS ch, CAST(round_even(hist_mean_period, 0) AS INT) AS ph
       FROM dsplit) t)"""


PRED_SQL = pred_sql(L)

CONF_SQL = """
conf AS (SELECT s.split, l.t AS true_label, l.p AS pred_label, COALESCE(c.n, 0.0e0) AS n
 FROM (SELECT DISTINCT split FROM pred) s
 CROSS JOIN (SELECT CAST(a AS INT) AS t, CAST(b AS INT) AS p FROM range(4) x(a) CROSS JOIN range(4) y(b)) l
 LEFT JOIN (SELECT split, y_phase AS t, pred_label AS p, CAST(SUM(w) AS DOUBLE) AS n FROM pred GROUP BY 1, 2, 3) c
  ON c.split = s.split AND c.t = l.t AND c.p = l.p)"""

REP_SQL = """
rep AS (SELECT split, label, [ 'menstruation', 'follicular', 'ovulation', 'luteal' ][label + 1] AS class_name,
  COALESCE(tp / NULLIF(predicted, 0), 0.0e0) AS precision, COALESCE(tp / NULLIF(support, 0), 0.0e0) AS recall,
  COALESCE(tp * 2.0e0 / NULLIF(support + predicted, 0), 0.0e0) AS f1, support, predicted, tp
 FROM (SELECT split, true_label AS label, SUM(n) AS support, SUM(n) FILTER (WHERE true_label = pred_label) AS tp
       FROM conf GROUP BY 1, 2) a
 JOIN (SELECT split, pred_label AS label, SUM(n) AS predicted FROM conf GROUP BY 1, 2) b USING (split, label))"""

SUMM_SQL = """
summ AS (SELECT split, SUM(tp) / SUM(support) AS accuracy, AVG(f1) FILTER (WHERE support + predicted > 0) AS macro_f1,
  SUM(f1 * support) / SUM(support) AS weighted_f1 FROM rep GROUP BY split)"""

REG_SQL = """
reg AS (SELECT split, SUM(w * abs(pred_reg - y_reg)) / SUM(w) AS mae,
  sqrt(SUM(w * (pred_reg - y_reg) * (pred_reg - y_reg)) / SUM(w)) AS rmse,
  SUM(w * -ln(CASE WHEN pred_label = y_phase THEN 0.85e0 ELSE 0.05e0 END)) / SUM(w) AS cross_entropy
 FROM pred GROUP BY split)"""


def E(body: str, *more: str) -> str:
    return P(body, PRED_SQL, CONF_SQL, REP_SQL, SUMM_SQL, REG_SQL, *more)


def _split_daily(spark, sf):
    return split_daily(episodes(spark, sf))


def predictions(spark, sf, n: int = L):
    p = forecast.history_forecast(_split_daily(spark, sf))
    return p.select("split", "user_id", "cycle_start_date", "day_in_cycle",
                    F.col("phase_label").alias("y_phase"),
                    F.col("days_until_next_cycle").cast("double").alias("y_reg"),
                    "pred_label", "pred_reg", "probs",
                    sequences.timestep_weight("day_in_cycle", "cycle_length", n).alias("w"))


@query("forecast_history", E("""
SELECT split, user_id, cycle_start_date, day_in_cycle, y_phase, y_reg, pred_label, pred_reg, w FROM pred"""))
def q_forecast_history(spark, sf):
    return predictions(spark, sf).drop("probs")


@query("confusion_matrix", E("SELECT * FROM conf"))
def q_confusion_matrix(spark, sf):
    return evaluate.confusion_long(predictions(spark, sf), "y_phase", "pred_label", ["split"], "w")


@query("class_report", E("SELECT split, label, class_name, precision, recall, f1, support, predicted FROM rep"))
def q_class_report(spark, sf):
    conf = evaluate.confusion_long(predictions(spark, sf), "y_phase", "pred_label", ["split"], "w")
    return evaluate.class_report(conf, ["split"]).drop("tp")


@query("macro_weighted_f1", E("""
SELECT split, round(accuracy, 9) AS accuracy, round(macro_f1, 9) AS macro_f1, round(weighted_f1, 9) AS weighted_f1
FROM summ"""))
def q_macro_weighted_f1(spark, sf):
    conf = evaluate.confusion_long(predictions(spark, sf), "y_phase", "pred_label", ["split"], "w")
    s = evaluate.summary_scores(evaluate.class_report(conf, ["split"]), ["split"])
    return s.select("split", *[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@query("regression_error", E("SELECT split, round(mae, 9) AS mae, round(rmse, 9) AS rmse FROM reg"))
def q_regression_error(spark, sf):
    r = evaluate.regression_error(predictions(spark, sf), "y_reg", "pred_reg", ["split"], "w")
    return r.select("split", F.round("mae", 9).alias("mae"), F.round("rmse", 9).alias("rmse"))


@query("composite_loss", E("""
SELECT split, round(cross_entropy, 9) AS cross_entropy, round(mae, 9) AS mae,
 round(1.0e0 * cross_entropy + 0.1e0 * mae, 9) AS composite_loss FROM reg"""))
def q_composite_loss(spark, sf):
    c = evaluate.composite_loss(predictions(spark, sf), "y_phase", "probs", "y_reg", "pred_reg", ["split"], "w")
    return c.select("split", *[F.round(x, 9).alias(x) for x in ("cross_entropy", "mae", "composite_loss")])


_TOP = ["accuracy", "macro_f1", "weighted_f1", "mae", "rmse", "cross_entropy", "composite_loss"]


METRICS_SQL = "\nUNION ALL\n".join(
    [f"SELECT split, '{m}' AS metric, CAST(NULL AS VARCHAR) AS class_name, round({m}, 9) AS value "
     f"FROM summ JOIN reg USING (split) JOIN (SELECT split, 1.0e0 * cross_entropy + 0.1e0 * mae AS composite_loss "
     f"FROM reg) cl USING (split)" for m in _TOP]
    + [f"SELECT split, '{m}', class_name, round({m}, 9) FROM rep" for m in ("precision", "recall", "f1", "support")])


@query("metrics_report", E(METRICS_SQL))
def q_metrics_report(spark, sf):
    return evaluate.metrics_report(predictions(spark, sf), ["split"], "w")


@query("metrics_per_day", E("""
SELECT split, round(SUM(CASE WHEN y_phase = pred_label THEN 1 ELSE 0 END) * 1.0e0 / COUNT(*), 9) AS accuracy,
 round(AVG(abs(pred_reg - y_reg)), 9) AS mae FROM pred GROUP BY split"""))
def q_metrics_per_day(spark, sf):
    """T12: the same scores over distinct days (weight 1) instead of window timesteps."""
    p = predictions(spark, sf)
    conf = evaluate.confusion_long(p, "y_phase", "pred_label", ["split"])
    acc = evaluate.summary_scores(evaluate.class_report(conf, ["split"]), ["split"])
    reg = evaluate.regression_error(p, "y_reg", "pred_reg", ["split"])
    return acc.join(reg, "split").select("split", F.round("accuracy", 9).alias("accuracy"),
                                         F.round("mae", 9).alias("mae"))


# --- rows-only: distributed model fits (no SQL twin) --------------------------

def _scaled(spark, sf):
    scaled, _ = split_and_scale(episodes(spark, sf))
    return scaled


@query("phase_classifier")
def q_phase_classifier(spark, sf):
    scaled = _scaled(spark, sf)
    model = forecast.fit_phase_classifier(scaled)
    p = forecast.score_phase_classifier(model, scaled)
    return p.select("split", "user_id", "cycle_start_date", "day_in_cycle_raw", "phase_label",
                    "pred_label", "probs")


@query("countdown_regressor")
def q_countdown_regressor(spark, sf):
    ep, params = scaled_episodes(episodes(spark, sf))
    scaled = scaled_days(ep, params)
    model = forecast.fit_countdown_regressor(countdown_moments(ep, params), weight="weight")
    p = forecast.score_countdown_regressor(model, scaled)
    return p.select("split", "user_id", "cycle_start_date", "day_in_cycle_raw",
                    "days_until_next_cycle", "pred_reg")


@query("window_model")
def q_window_model(spark, sf):
    from pyspark.ml.functions import vector_to_array
    w = sequences.windows(window_source(episodes(spark, sf)), L)
    flat = forecast.flatten_window_features(w)
    clf, reg = forecast.fit_window_models(flat)
    out = reg.transform(clf.transform(flat).withColumn("probs", vector_to_array("probability"))
                        .drop("rawPrediction", "probability")
                        .withColumnRenamed("prediction", "pred_label"))
    return out.select("split", "user_id", "cycle_start_date", "seq_length", "window_start", "y_last",
                      F.col("pred_label").cast("int").alias("pred_label"), "r_last",
                      F.col("prediction").alias("pred_reg"))


@query("batch_score")
def q_batch_score(spark, sf):
    """FCT5: the fitted FCT2 coefficients scored per Arrow batch in the executors."""
    scaled = _scaled(spark, sf)
    model = forecast.fit_phase_classifier(scaled)
    predict = forecast.softmax_predictor(model.coefficientMatrix.toArray(),
                                         model.interceptVector.toArray())
    feats = S.input_features
    return forecast.score_batches(
        scaled.select("split", "user_id", "cycle_start_date", "day_in_cycle_raw",
                      *[F.col(c).cast("double").alias(c) for c in feats]),
        feats, predict,
        "pred_label int, probs array<double>, split string, user_id long, cycle_start_date date, "
        "day_in_cycle_raw int",
        keep=["split", "user_id", "cycle_start_date", "day_in_cycle_raw"])
