"""Enforced stages, exact quantiles, history keys."""

import json
import os

import numpy as np
import pytest

from panelspark.operators import evaluate, profile, sequences
from panelspark.operators.quality import DataQualityError
from panelspark.plans.pipelines import daily_panel, ordered_daily
from panelspark.plans.stages import build_daily, build_splits, build_windows
from panelspark.sources import io

from helpers import F, episode, frame


def _eps(n=30):
    return [e for u in range(1, n + 1) for e in (episode(u, "2024-01-01", 22 + u % 9, 3 + u % 3),
                                                 episode(u, "2024-03-01", 25 + u % 4, 4))]


def test_clean_data_passes_every_stage(spark, tmpdir_path):
    daily = build_daily(frame(spark, _eps()), tmpdir_path + "/a")
    panel = build_splits(daily, tmpdir_path + "/b")
    meta = build_windows(panel, tmpdir_path + "/c", [14, 21])
    rows = {(r.split, r.seq_length): (r.n_windows, r.n_features) for r in meta.collect()}
    lengths = [x for u in range(1, 31) for x in (22 + u % 9, 25 + u % 4)]
    assert sum(n for (_, s), (n, _) in rows.items() if s == 21) == sum(x - 20 for x in lengths)
    assert {f for _, f in rows.values()} == {18}
    with pytest.raises(DataQualityError, match="n_null_target"):
        build_splits(daily.withColumn("phase_label", F.when(F.col("day_in_cycle") != 3, F.col("phase_label"))),
                     tmpdir_path + "/null_target")
    with pytest.raises(DataQualityError, match="n_non_binary"):
        build_splits(daily.withColumn("diet_balanced", F.lit(2)), tmpdir_path + "/indicator")
    with pytest.raises(DataQualityError):
        build_splits(daily.drop("diet_balanced"), tmpdir_path + "/stage")
    with pytest.raises(DataQualityError, match="no_windows"):
        build_windows(panel, tmpdir_path + "/long", 60)
    with pytest.raises(DataQualityError, match="label_domain"):
        build_windows(panel.withColumn("phase_label", F.lit(7)), tmpdir_path + "/labels", 21)
    with pytest.raises(ValueError, match="age"):
        build_windows(panel.drop("age"), tmpdir_path + "/features", 21)


@pytest.mark.parametrize("bad, rule", [
    (episode(90, "2024-01-01", 0, 3, nxt="2024-02-01"), "length_positive"),
    (episode(90, "2024-01-01", 28, 0), "prefix_positive"),
    (episode(90, "2024-01-01", 28, 30), "prefix_below_length"),
    (episode(90, "2024-01-01", 28, 5, nxt="2023-12-01"), "next_after_start"),
    (episode(90, "2024-01-01", 28, 5, ex="Extreme"), "exercise_frequency_ordinal_invalid"),
    (episode(None, "2024-01-01", 28, 5), "null_entity_key"),
    (episode(1, "2024-01-01", 23, 4), "episode_day_set"),  # the start of another row
    (episode(90, "2024-01-01", 28, 5, nxt="2024-01-10"), "countdown_negative"),
])
def test_each_error_stops_the_daily_stage(spark, tmpdir_path, bad, rule):
    with pytest.raises(DataQualityError, match=rule):
        build_daily(frame(spark, _eps(2) + [bad]), tmpdir_path)


def test_ordered_daily_needs_every_column(spark):
    with pytest.raises(ValueError, match="diet"):
        ordered_daily(daily_panel(frame(spark, _eps(1))).drop("diet"))


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    cols = {"skewed": np.exp(rng.normal(0, 6, 2000)), "ties": rng.integers(0, 4, 2000).astype(float),
            "constant": np.full(2000, 7.5), "signed": rng.normal(-5, 100, 2000)}
    data = [tuple(float(v[i]) for v in cols.values()) for i in range(2000)]
    df = spark.createDataFrame(data + [(None, float("nan"), None, None)], ", ".join(f"{c} double" for c in cols))
    qs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    for buckets in (4, 4096):
        got = {r.column_name: r for r in profile.quantiles(df, list(cols), qs, buckets).collect()}
        for c, v in cols.items():
            assert np.allclose([got[c][f"q{i}"] for i in range(len(qs))], np.quantile(v, qs), rtol=1e-12), c


def test_quantiles_of_one_value_none_and_no_rows(spark):
    one = spark.createDataFrame([(5.0, None)], "a double, b double")
    rows = {r.column_name: r for r in profile.describe(one, ["a", "b"]).collect()}
    assert (rows["a"].p25, rows["a"].p75, rows["a"]["count"]) == (5.0, 5.0, 1)
    assert rows["b"].p50 is None and rows["b"]["count"] == 0
    empty = profile.describe(one.limit(0), ["a"]).first()
    assert empty["count"] == 0 and empty.p50 is None
    assert profile.entity_overview(frame(spark, [])).first().median_per_entity is None


def test_no_column_meets_in_one_task(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"))
    for out in (profile.describe(df, ["x"]), profile.distinct_values(df, ["x"]), profile.boxplot_stats(df, ["x"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "collect_set" not in plan


@pytest.mark.parametrize("curve, train, val", [
    ("loss", "loss", "val_loss"),
    ("phase_accuracy", "phase_output_accuracy", "val_accuracy"),
    ("phase_accuracy", "phase_output_acc", "val_phase_output_acc"),
    ("phase_accuracy", "accuracy", "val_acc"),
    ("phase_accuracy", "acc", "val_phase_output_accuracy"),
    ("regression_mae", "regression_output_mae", "val_mae"),
    ("regression_mae", "regression_output_mean_absolute_error", "val_regression_mae"),
    ("regression_mae", "regression_mae", "val_regression_output_mean_absolute_error"),
    ("regression_mae", "mae", "val_regression_output_mae"),
])
def test_every_history_key(spark, curve, train, val):
    hist = spark.createDataFrame([("r", [0.1, 0.2], [0.3, 0.4])], f"experiment string, {train} array<double>, "
                                                                  f"{val} array<double>")
    rows = evaluate.learning_curves(evaluate.history_long(hist)).orderBy("epoch").collect()
    assert [tuple(r) for r in rows] == [("r", curve, 1, 0.1, 0.3), ("r", curve, 2, 0.2, 0.4)]


def test_first_key_wins_and_a_missing_side_is_null(spark):
    hist = spark.createDataFrame([("r", [0.1], [0.9])], "experiment string, phase_output_accuracy array<double>, "
                                                        "acc array<double>")
    assert tuple(evaluate.learning_curves(evaluate.history_long(hist)).first()) == ("r", "phase_accuracy", 1, 0.1, None)


def test_contract_update_keeps_other_sections(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "contract")
    io.write_contract(spark, path)
    before = io.read_contract(spark, path)
    io.update_contract(spark, path, {"stage": "scaled", "scaler": {"age": None}})
    assert io.read_contract(spark, path) == {**before, "stage": "scaled", "scaler": {"age": None}}
    pretty = os.path.join(tmpdir_path, "pretty.json")
    io.write_json_doc(pretty, before)
    assert io.read_contract(spark, pretty) == json.loads(json.dumps(before))


def test_window_counts_of_short_episodes(spark):
    sizes = spark.createDataFrame([(13,), (14,), (20,)], "__n int")
    r = sequences.window_counts(sizes, [14]).first()
    assert (r.n_episodes, r.n_skipped, r.n_windows_expected, r.n_windows) == (3, 1, 8, 8)
