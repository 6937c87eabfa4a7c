import random

from pyspark.sql import functions as F

from helpers import episode, frame
from panelspark.operators import sequences
from panelspark.plans.pipelines import daily_panel
from panelspark.spec import DEFAULT


def _rows(spark, lengths):
    eps = [episode(i, "2024-01-01", n, 3) for i, n in enumerate(lengths, start=1)]
    return sequences.episode_rows(daily_panel(frame(spark, eps)), DEFAULT.input_features)


def test_h6_windows_and_skips(spark):
    er = _rows(spark, [20, 21, 28])
    c = {r["seq_length"]: r.asDict() for r in sequences.window_counts(er, [14, 21]).collect()}
    assert (c[21]["n_windows"], c[21]["n_skipped"]) == (9, 1)
    assert (c[14]["n_windows"], c[14]["n_skipped"]) == (30, 0)
    assert all(v["n_windows"] == v["n_windows_expected"] for v in c.values())


def test_windows_are_contiguous_slices(spark):
    er = _rows(spark, [25, 22])
    w = sequences.window_arrays(sequences.windows(er, 21)).orderBy("user_id", "window_start").collect()
    assert len(w) == 5 + 2
    for r in w:
        days = [int(x[0]) for x in r["X"]]  # first feature is the (unscaled) day
        assert days == list(range(r["window_start"], r["window_start"] + 21))
        assert len(r["y_phase"]) == len(r["y_reg"]) == 21
        assert all(len(x) == len(DEFAULT.input_features) for x in r["X"])


def test_window_count_closed_form_property(spark):
    rnd = random.Random(11)
    lengths = [rnd.randint(5, 45) for _ in range(60)]
    er = _rows(spark, lengths)
    for L in (7, 14, 21, 40):
        got = sequences.window_counts(er, [L]).collect()[0]
        assert got["n_windows"] == sum(max(n - L + 1, 0) for n in lengths)
        assert got["n_skipped"] == sum(n < L for n in lengths)


def test_timestep_weight_equals_flattened_windows(spark):
    er = _rows(spark, [23, 30, 21, 19])
    flat = sequences.flatten_windows(sequences.windows(er, 21))
    per_day = flat.groupBy("user_id", "day").count()
    w = er.select("user_id", F.size("rows").alias("n"), F.explode(F.sequence(F.lit(0), F.size("rows") - 1))
                  .alias("day")).withColumn("w", sequences.timestep_weight("day", "n", 21))
    got = {(r.user_id, r.day): r.w for r in w.filter("w > 0").collect()}
    ref = {(r.user_id, r.day): r["count"] for r in per_day.collect()}
    assert got == ref


def test_fast_digest_equals_sliced_digest(spark):
    er = _rows(spark, [23, 30, 21, 19, 40])
    for L in (14, 21):
        a = sequences.window_digest(sequences.windows(er, L))
        b = sequences.window_digest_from_rows(er, L)
        cols = sorted(a.columns)
        assert sorted(cols) == sorted(b.columns)
        assert sorted(tuple(r) for r in a.select(*cols).collect()) == \
            sorted(tuple(r) for r in b.select(*cols).collect())


def test_direct_rows_equal_collected_rows(spark):
    from panelspark.plans.pipelines import split_and_scale, window_source
    eps = [episode(u, "2024-01-01", 20 + u, 3 + u % 4) for u in range(1, 25)]
    df = frame(spark, eps)
    scaled, _ = split_and_scale(df)
    collected = sequences.episode_rows(scaled, DEFAULT.input_features, order_col="day_in_cycle_raw")
    direct = window_source(df)
    key = ["user_id", "cycle_start_date", "split"]
    a = {tuple(r[k] for k in key): r["rows"] for r in collected.collect()}
    b = {tuple(r[k] for k in key): r["rows"] for r in direct.collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert [tuple(x["x"]) + (x["o"], x["y"], x["r"]) for x in a[k]] == \
            [tuple(x["x"]) + (x["o"], x["y"], x["r"]) for x in b[k]]


def test_windows_by_position_equals_collected_windows(spark):
    """The skew-safe generator gives the same windows as collecting each group."""
    rnd = random.Random(9)
    rows = [(rnd.choice([1, 1, 1, 1, 2, 3]), rnd.randint(0, 50), i, float(rnd.randint(0, 9))) for i in range(700)]
    df = spark.createDataFrame(rows, "g long, t int, id long, v double").withColumn("c", F.floor(F.col("t") / 10))
    a = sequences.windows_by_position(df, ["g"], "c", ["t", "id"], 4, {"v": "v", "id": "id"})
    got = {(r.g, r.window_start): [x["id"] for x in r.win] for r in a.collect()}
    ref = {}
    for g in {r[0] for r in rows}:
        ids = [r[2] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))]
        for s in range(len(ids) - 3):
            ref[(g, s)] = ids[s:s + 4]
    assert got == ref
