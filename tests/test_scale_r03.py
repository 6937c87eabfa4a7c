"""Work per day and per window that grew faster than it must."""

import numpy as np
import pytest
from helpers import episode, frame
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelspark.operators import forecast, sequences
from panelspark.operators.network import Network
from panelspark.plans import pipelines, q_stages
from panelspark.spec import DEFAULT as S


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def scaled(spark):
    rows = [episode(u, f"2024-0{m}-01", 22 + (u * 5 + m) % 12, 3 + (u + m) % 4, diet=("Balanced", "Low Carb")[u % 2])
            for u in range(1, 31) for m in range(1, 5)]
    ep, params = pipelines.scaled_episodes(frame(spark, rows))
    return ep, params, pipelines.scaled_days(ep, params).cache()


def test_countdown_fit_on_two_rows_per_episode_is_the_fit_on_its_days(scaled):
    ep, params, days = scaled
    moments = pipelines.countdown_moments(ep, params)
    assert moments.count() == 2 * ep.count()
    few, all_days = forecast.fit_countdown_regressor(moments, weight="weight"), forecast.fit_countdown_regressor(days)
    assert np.allclose(few.coefficients.toArray(), all_days.coefficients.toArray(), rtol=1e-7, atol=1e-7)
    assert few.intercept == pytest.approx(all_days.intercept, rel=1e-7)


def test_cuts_and_parameters_are_found_once(scaled):
    assert "Aggregate" not in _plan(scaled[2])


def test_column_scores_are_those_of_the_model_and_of_batches(scaled):
    days, features = scaled[2], S.input_features
    clf, reg = forecast.fit_phase_classifier(days, max_iter=5), forecast.fit_countdown_regressor(days)
    keys = ["user_id", "cycle_start_date", "day_in_cycle_raw"]
    own = forecast.score_countdown_regressor(reg, forecast.score_phase_classifier(clf, days))
    assert "UDF" not in _plan(own)
    theirs = clf.transform(forecast._assemble(days, features)).select(*keys, "prediction", "probability")
    theirs = theirs.join(reg.transform(forecast._assemble(days, features)).select(*keys, F.col("prediction").alias("p")), keys)
    batched = forecast.score_batches(days.select(*keys, *[F.col(c).cast("double").alias(c) for c in features]), features,
                                     forecast.softmax_predictor(clf.coefficientMatrix.toArray(), clf.interceptVector.toArray()),
                                     "pred_label int, probs array<double>, user_id long, cycle_start_date date, day_in_cycle_raw int", keys)
    assert "MapInArrow" in _plan(batched)
    a, b, c = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (own, theirs, batched))
    assert len(a) == len(b) == len(c) == days.count()
    for k, r in a.items():
        assert r.pred_label == b[k].prediction == c[k].pred_label
        assert r.probs == pytest.approx(list(b[k].probability), abs=1e-9) and c[k].probs == pytest.approx(r.probs, abs=1e-9)
        assert r.pred_reg == pytest.approx(b[k].p, abs=1e-9)


def test_null_feature_fails_the_scoring(scaled):
    days = scaled[2]
    clf = forecast.fit_phase_classifier(days, max_iter=2)
    with pytest.raises(PySparkException):
        forecast.score_phase_classifier(clf, days.withColumn("age", F.lit(None).cast("double"))).select("probs").collect()


def test_window_sums_need_no_growing_arrays(spark):
    rows = frame(spark, [episode(1, "2024-01-01", 40, 5), episode(2, "2024-01-01", 21, 4), episode(3, "2024-01-01", 9, 4)])
    ep = sequences.episode_rows(pipelines.daily_panel(rows), features=[])
    fast = sequences.window_digest_from_rows(ep, [1, 14, 21, 40])
    assert "aggregate(" not in _plan(fast)
    slow = sequences.window_digest(sequences.windows(ep, [1, 14, 21, 40])).select(*fast.columns)
    order = ["seq_length", "user_id", "window_start"]
    assert fast.orderBy(*order).collect() == slow.orderBy(*order).collect()


def test_windows_are_cut_by_plain_slices(spark):
    ep = sequences.episode_rows(pipelines.daily_panel(frame(spark, [episode(1, "2024-01-01", 25, 5)])), features=["age"])
    w = sequences.windows(ep, [14, 30, 21])
    assert "lambda" not in _plan(w).split("Aggregate")[0]
    assert sorted((r.seq_length, r.window_start, len(r.win)) for r in w.collect()) == \
        [(14, s, 14) for s in range(12)] + [(21, s, 21) for s in range(5)]
    assert "lambda" not in _plan(forecast.flatten_window_features(w)).split("Aggregate")[0]


def test_tensor_digest_builds_no_struct_per_cell(scaled):
    ep, params, _ = scaled
    rows = sequences.episode_rows_direct(ep, params, S.input_features)
    d = q_stages.tensor_digest(sequences.window_arrays(sequences.windows(rows, 21)))
    top = _plan(d).split("Generate explode(sequence")[0]
    assert "arrays_zip" not in top
    r = d.filter(F.col("n_windows") > 1).first()
    assert r.seq_length == 21 and r.y_reg is not None


def test_network_first_steps_are_at_unit_stride():
    net = Network(3, 4, 5, 6)
    x = np.random.default_rng(1).random((7, 4, 3))
    states, _ = net._encode(net.split(net.initial(1)), np.ascontiguousarray(x.transpose(1, 0, 2)))
    assert states.shape == (4, 7, 5)
    probs, days = net.predict(net.initial(1), x)
    assert probs.shape == (7, 4, 4) and days.shape == (7, 4)
