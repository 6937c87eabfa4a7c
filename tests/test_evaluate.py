import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from panelspark.operators import evaluate, forecast, quality
from panelspark.spec import DEFAULT

H13 = [[1387, 766, 0, 0], [239, 30542, 0, 2772], [0, 1111, 0, 562], [0, 4678, 0, 7146]]


def _conf(spark, m, split="val"):
    rows = [(split, t, p, float(m[t][p])) for t in range(4) for p in range(4)]
    return spark.createDataFrame(rows, "split string, true_label int, pred_label int, n double")


def test_h13_golden_report(spark):
    rep = evaluate.class_report(_conf(spark, H13), ["split"])
    s = evaluate.summary_scores(rep, ["split"]).collect()[0]
    assert s["accuracy"] == pytest.approx(0.794158892750442, abs=1e-12)
    assert s["macro_f1"] == pytest.approx(0.5598596732014214, abs=1e-12)
    assert s["weighted_f1"] == pytest.approx(0.7757038782756215, abs=1e-12)
    c2 = rep.filter("label = 2").collect()[0]
    assert (c2["precision"], c2["recall"], c2["f1"]) == (0.0, 0.0, 0.0)


def test_h14_argmax_first_on_ties(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.1, 0.2, 0.7],)], "p array<double>")
    assert [r[0] for r in df.select(evaluate.argmax_label("p")).collect()] == [0, 2]


def test_any_number_of_classes(spark):
    spec = replace(DEFAULT, phase_names=("off", "idle", "run", "fault", "repair", "test"))
    p = [1 / 6] * 6
    rows = [("a", 5, 5, p, 1.0, 2.0), ("a", 4, 5, p, 2.0, 2.0), ("a", 0, 0, p, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "split string, y_phase int, pred_label int, probs array<double>, y_reg double, pred_reg double")
    got = {(r.metric, r.class_name): r.value for r in evaluate.metrics_report(df, names=spec.phase_names).collect()}
    assert {c for _, c in got if c} == set(spec.phase_names)
    assert got["accuracy", None] == pytest.approx(2 / 3, abs=1e-8) and got["cross_entropy", None] == pytest.approx(math.log(6), abs=1e-8)
    assert got["precision", "test"] == 0.5 and got["recall", "repair"] == 0 and got["support", "idle"] == 0
    w = spark.createDataFrame([([[0.0]], [5], [1.0]), ([[0.0]], [6], [1.0])], "X array<array<double>>, y_phase array<int>, y_reg array<double>")
    for own, bad in ((spec, 1), (DEFAULT, 2)):
        assert {r.check: r.violations for r in quality.window_report(w, 1, 1, own).collect()}["label_domain"] == bad
    daily = spark.createDataFrame([(2, 10.0, 4.0)], "day_in_cycle int, hist_mean_cycle double, hist_mean_period double")
    probs = forecast.history_forecast(daily, spec).first().probs
    assert len(probs) == 6 and sum(probs) == pytest.approx(1)


def test_confusion_keeps_empty_cells_and_absent_classes(spark):
    rows = [(0, 0), (0, 1), (1, 1), (1, 1)]
    df = spark.createDataFrame(rows, "y int, yhat int")
    conf = evaluate.confusion_long(df, "y", "yhat")
    assert conf.count() == 16 and conf.agg(F.sum("n")).first()[0] == 4
    s = evaluate.summary_scores(evaluate.class_report(conf)).first()
    # classes 2 and 3 are absent from truth and prediction: macro over {0, 1}
    f1_0, f1_1 = 2 * 1 / (2 + 1), 2 * 2 / (2 + 3)
    assert s["macro_f1"] == pytest.approx((f1_0 + f1_1) / 2)


def test_regression_and_composite_loss(spark):
    rows = [(0, [0.9, 0.05, 0.03, 0.02], 10.0, 12.0, 1.0), (1, [0.0, 0.0, 1.0, 0.0], 5.0, 4.0, 3.0)]
    df = spark.createDataFrame(rows, "y int, p array<double>, r double, rhat double, w double")
    e = evaluate.regression_error(df, "r", "rhat", weight="w").first()
    assert e["mae"] == pytest.approx((2 * 1 + 1 * 3) / 4)
    assert e["rmse"] == pytest.approx(math.sqrt((4 * 1 + 1 * 3) / 4))
    c = evaluate.composite_loss(df, "y", "p", "r", "rhat", weight="w").first()
    ce = (-math.log(0.9) * 1 + -math.log(1e-7) * 3) / 4
    assert c["cross_entropy"] == pytest.approx(ce)
    assert c["composite_loss"] == pytest.approx(ce + 0.1 * e["mae"])


def test_metrics_nested_layout(spark):
    rows = [("val", 0, 0, 10.0, 9.0, [1.0, 0.0, 0.0, 0.0]), ("val", 1, 0, 3.0, 5.0, [0.6, 0.4, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "split string, y_phase int, pred_label int, y_reg double, pred_reg double, "
                                     "probs array<double>")
    nested = evaluate.metrics_nested(evaluate.metrics_report(df)).first()
    assert nested["classification_accuracy"] == 0.5
    assert set(nested["classification_report"]) == {"menstruation", "follicular", "ovulation", "luteal"}
