import os

from pyspark.sql import functions as F

from helpers import episode, frame, rows_by
from panelspark.operators import evaluate
from panelspark.operators.history import add_history
from panelspark.sources import io
from panelspark.spec import DEFAULT
from panelspark.streaming.daily import stateful_history, stream_daily_panel


def test_h12_header_normalisation_and_typed_csv(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "raw.csv")
    with open(p, "w") as f:
        f.write(" User ID ,Age,BMI,Stress Level,Exercise Frequency,Sleep Hours,Diet,Cycle  Start-Date,"
                "Cycle Length,Period Length,Next Cycle Start Date,Symptoms\n")
        f.write("1,30,22.5,2,Low,7.0,Balanced,2024-01-01,28,5,2024-01-29,Cramps\n")
        f.write("2,x,22.5,2,Low,7.0,Balanced,not-a-date,28,5,2024-01-29,Cramps\n")
    from panelspark.spec import snake
    assert [snake(" User ID "), snake("Cycle  Start-Date"), snake("A_ _B")] == \
        ["user_id", "cycle_startdate", "a_b"]
    import pytest
    with pytest.raises(ValueError):  # Start-Date normalises to cycle_startdate: required column missing
        io.read_episodes_csv(spark, p)
    with open(p, "w") as f:
        f.write("User ID,Age,BMI,Stress Level,Exercise Frequency,Sleep Hours,Diet,Cycle Start Date,"
                "Cycle Length,Period Length,Next Cycle Start Date,Symptoms\n")
        f.write("1,30,22.5,2,Low,7.0,Balanced,2024-01-01,28,5,2024-01-29,Cramps\n")
        f.write("2,x,22.5,2,Low,7.0,Balanced,not-a-date,28,5,2024-01-29,Cramps\n")
    r = rows_by(io.read_episodes_csv(spark, p), "user_id")
    assert str(r[0]["cycle_start_date"]) == "2024-01-01" and r[0]["cycle_length"] == 28
    assert r[1]["age"] is None and r[1]["cycle_start_date"] is None


def test_sinks_roundtrip(spark, tmpdir_path):
    from panelspark.plans.pipelines import daily_panel
    eps = [episode(u, "2024-01-01", 25 + u, 4) for u in range(1, 8)]
    d = daily_panel(frame(spark, eps))
    out = os.path.join(tmpdir_path, "daily")
    io.write_daily(d, out)
    back = io.read_daily(spark, out)
    assert back.columns == DEFAULT.daily_columns and back.count() == d.count()
    from panelspark.plans.pipelines import daily_for_sink
    out2 = os.path.join(tmpdir_path, "daily_ranged")
    io.write_daily(daily_for_sink(frame(spark, eps)), out2)
    back2 = io.read_daily(spark, out2)
    assert back2.count() == d.count()
    plan = daily_for_sink(frame(spark, eps))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "Exchange" not in plan.split("Generate")[0]
    io.write_contract(spark, os.path.join(tmpdir_path, "contract"), stage="encoded")
    c = io.read_contract(spark, os.path.join(tmpdir_path, "contract"))
    assert c["stage"] == "encoded" and c["input_features"] == DEFAULT.input_features


def test_reports_leaderboard_and_history(spark, tmpdir_path):
    rep = os.path.join(tmpdir_path, "reports")
    os.makedirs(rep)
    for name, f1, key, opt in [("run_a", 0.55, "experiment_config", "optimizer_name"),
                               ("run_b", 0.61, "baseline_config", "optimizer")]:
        io.write_json_doc(os.path.join(rep, f"{name}_metrics.json"), {
            "test": {"classification_accuracy": 0.7, "macro_f1": f1, "weighted_f1": 0.7,
                     "regression_mae_days": 5.0, "regression_rmse_days": 6.0},
            key: {opt: "Adam", "seq_length": 21}})
        io.write_json_doc(os.path.join(rep, f"{name}_history.json"), {
            "loss": [3.0, 2.0, 1.5, 1.6], "val_loss": [2.5, 1.9, 2.0, 2.1],
            "phase_output_accuracy": [0.5, 0.6, 0.7, 0.7], "val_phase_output_accuracy": [0.5, 0.6, 0.6, 0.6]})
    lb = io.read_reports(spark, os.path.join(rep, "*_metrics.json"))
    board = evaluate.leaderboard(lb).collect()
    assert [r.experiment for r in board] == ["run_b", "run_a"] and board[0].optimizer == "Adam"
    hist = evaluate.history_long(io.read_histories(spark, os.path.join(rep, "*_history.json")))
    best = {r.experiment: r.best_epoch for r in evaluate.best_epoch(hist).collect()}
    assert best == {"run_a": 2, "run_b": 2}
    curves = evaluate.learning_curves(hist).filter("curve = 'phase_accuracy' AND epoch = 3").collect()
    assert curves[0]["train"] == 0.7 and curves[0]["val"] == 0.6


def test_streaming_history_equals_batch(spark, tmpdir_path):
    eps = [episode(1, "2024-01-01", 28, 5), episode(1, "2024-01-29", 30, 4), episode(2, "2024-01-03", 27, 6),
           episode(1, "2024-02-28", 27, 6), episode(2, "2024-01-30", 26, 3)]
    src = os.path.join(tmpdir_path, "in")
    frame(spark, eps[:3]).coalesce(1).write.parquet(os.path.join(src, "b1"))
    frame(spark, eps[3:]).coalesce(1).write.parquet(os.path.join(src, "b2"))
    schema = frame(spark, eps).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", True).parquet(src)
    q = stateful_history(stream).writeStream.format("memory").queryName("hist_stream") \
        .outputMode("append").option("checkpointLocation", os.path.join(tmpdir_path, "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = rows_by(spark.sql("SELECT * FROM hist_stream"), "user_id", "cycle_start_date")
    ref = rows_by(add_history(frame(spark, eps)), "user_id", "cycle_start_date")
    for a, b in zip(got, ref):
        for c in ("hist_mean_cycle", "hist_mean_period", "is_historical_data_missing", "n_prior_episodes"):
            assert a[c] == b[c], (c, a, b)
    assert all(r["late_episode"] == 0 for r in got)
    daily = stream_daily_panel(stream)
    assert daily.isStreaming and F is not None


def test_stage_sinks_roundtrip_and_stage_guard(spark, tmpdir_path):
    import pytest
    from panelspark.operators import quality, sequences, split
    from panelspark.plans.pipelines import split_and_scale, split_episodes, window_source
    eps = [episode(u, "2024-01-01", 22 + u % 9, 3 + u % 3) for u in range(1, 40)]
    df = frame(spark, eps)
    scaled, params = split_and_scale(df)
    io.write_splits(scaled, os.path.join(tmpdir_path, "splits"))
    val = io.read_splits(spark, os.path.join(tmpdir_path, "splits"), ["val"])
    assert val.count() == scaled.filter("split = 'val'").count()
    io.write_membership(split.split_membership(df), os.path.join(tmpdir_path, "members"), (0.7, 0.15, 0.15), 42)
    assert spark.read.parquet(os.path.join(tmpdir_path, "members")).count() == 39
    io.write_scaler(params, os.path.join(tmpdir_path, "scaler"))
    assert spark.read.parquet(os.path.join(tmpdir_path, "scaler")).count() == 1
    w = sequences.window_arrays(sequences.windows(window_source(df), [14, 21]))
    io.write_windows(w, os.path.join(tmpdir_path, "windows"))
    back = io.read_windows(spark, os.path.join(tmpdir_path, "windows"), 21)
    assert back.count() == sum(max(22 + u % 9 - 20, 0) for u in range(1, 40))
    meta = {(r.split, r.seq_length): r.n_windows for r in io.window_metadata(w, 18).collect()}
    assert sum(v for (s, L), v in meta.items() if L == 14) == sum(22 + u % 9 - 13 for u in range(1, 40))
    rep = {r["check"]: r["violations"] for r in quality.window_report(back, 21, 18).collect()}
    assert rep["inner_length"] == rep["feature_width"] == rep["non_finite_value"] == 0
    with pytest.raises(quality.DataQualityError):
        split_episodes(df)  # DQ18: not encoded


def test_streaming_daily_sink_equals_batch_panel(spark, tmpdir_path):
    from panelspark.plans.pipelines import daily_panel
    from panelspark.streaming.daily import episode_stream, start_daily_sink
    eps = [episode(1, "2024-01-01", 28, 5), episode(2, "2024-01-03", 27, 6), episode(1, "2024-01-29", 30, 4)]
    src = os.path.join(tmpdir_path, "eps")
    frame(spark, eps[:2]).coalesce(1).write.parquet(os.path.join(src, "b1"))
    frame(spark, eps[2:]).coalesce(1).write.parquet(os.path.join(src, "b2"))
    stream = episode_stream(spark, src, frame(spark, eps).schema)
    out, ck = os.path.join(tmpdir_path, "daily_out"), os.path.join(tmpdir_path, "daily_ck")
    from panelspark.streaming.daily import stream_daily_panel
    q = start_daily_sink(stream_daily_panel(stream), out, ck)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    ref = daily_panel(frame(spark, eps))
    cols = ["user_id", "cycle_start_date", "day_in_cycle", "hist_mean_cycle", "phase_label",
            "days_until_next_cycle"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == \
        sorted(tuple(r) for r in ref.select(*cols).collect())
