import pytest

from helpers import episode, frame, rows_by
from panelspark.operators import encode, quality
from panelspark.operators.expand import expand_days
from panelspark.operators.history import add_history
from panelspark.spec import DEFAULT


def test_onehot_unknown_and_null_are_all_zero(spark):
    rows = [episode(1, "2024-01-01", 28, 5, diet="Keto"), episode(2, "2024-01-01", 28, 5, diet=None),
            episode(3, "2024-01-01", 28, 5, diet="High Sugar")]
    r = rows_by(encode.encode_categories(frame(spark, rows)), "user_id")
    diet_cols = [c for c in DEFAULT.onehot_columns if c.startswith("diet_")]
    assert [sum(x[c] for c in diet_cols) for x in r] == [0, 0, 1]
    assert r[2]["diet_high_sugar"] == 1
    assert all(x[c] is not None for x in r for c in diet_cols)


def test_ordinal_and_dq10(spark):
    rows = [episode(1, "2024-01-01", 28, 5, ex="Low"), episode(2, "2024-01-01", 28, 5, ex="High"),
            episode(3, "2024-01-01", 28, 5, ex="Extreme")]
    enc = encode.encode_categories(frame(spark, rows))
    assert [x["exercise_frequency_encoded"] for x in rows_by(enc, "user_id")] == [0, 2, None]
    rep = {x["check"]: x["violations"] for x in quality.episode_report(enc).collect()}
    assert rep["exercise_frequency_ordinal_invalid"] == 1
    with pytest.raises(quality.DataQualityError):
        quality.enforce(quality.episode_report(enc))


def test_unexpected_and_multilabel(spark):
    rows = [episode(1, "2024-01-01", 28, 5, symptoms="Cramps, Bloating"),
            episode(2, "2024-01-01", 28, 5, symptoms="Cramps/Bloating"),
            episode(3, "2024-01-01", 28, 5, symptoms=None)]
    df = frame(spark, rows)
    unexp = {(r["column_name"], r["value"]): r["n_rows"] for r in encode.unexpected_categories(df).collect()}
    assert unexp[("symptoms", None)] == 1 and unexp[("symptoms", "Cramps, Bloating")] == 1
    ml = {r["column_name"]: r["n_multilabel"] for r in encode.multilabel_values(df).collect()}
    assert ml["symptoms"] == 1  # builder pattern has no '/'
    ml2 = {r["column_name"]: r["n_multilabel"]
           for r in encode.multilabel_values(df, ("symptoms",), r",|;|/").collect()}
    assert ml2["symptoms"] == 2


def test_h9_null_rules(spark):
    rows = [episode(1, "2024-01-01", 28, 5)]
    df = frame(spark, rows).withColumn("cycle_length", encode.F.lit(None).cast("int")) \
        .withColumn("diet", encode.F.lit(None).cast("string"))
    rep = {x["check"]: x["violations"] for x in quality.episode_report(df, encoded=False).collect()}
    assert rep["length_positive"] == 1 and rep["prefix_below_length"] == 1
    enc = rows_by(encode.encode_categories(df), "user_id")[0]
    assert enc["diet_balanced"] == 0


def test_h10_duplicates(spark):
    rows = [episode(1, "2024-01-01", 28, 5), episode(1, "2024-01-01", 28, 5), episode(1, "2024-01-29", 28, 5)]
    df = frame(spark, rows)
    dup = quality.duplicate_episodes(df).collect()
    assert sum(r["n_rows"] for r in dup) == 2
    daily = expand_days(add_history(df))
    rep = {r["check"]: r["violations"] for r in quality.daily_report(daily, df).collect()}
    assert rep["episode_day_set"] == 1  # the duplicated episode has every day twice


def test_h11_arrival_order(spark):
    rows = [("A", "2024-01-01", 1), ("A", "2024-02-01", 2), ("A", "2024-02-01", 3),
            ("B", "2024-02-01", 4), ("B", "2024-01-01", 5)]
    df = spark.createDataFrame(rows, "user_id string, s string, seq int") \
        .withColumn("cycle_start_date", encode.F.to_date("s"))
    out = quality.nonchronological_entities(df, "seq").collect()
    assert [r["user_id"] for r in out] == ["B"]


def test_history_flags_and_daily_report_clean(spark):
    rows = [episode(1, "2024-01-01", 28, 5), episode(1, "2024-01-29", 30, 4), episode(2, "2024-03-01", 26, 5)]
    df = frame(spark, rows)
    h = add_history(df)
    assert all(r["violations"] == 0 for r in quality.history_flag_report(h).collect())
    rep = quality.daily_report(expand_days(h), df)
    quality.enforce(rep)  # no error-level violation


def test_leakage_guard():
    DEFAULT.check_no_leakage()
    with pytest.raises(ValueError):
        DEFAULT.check_no_leakage(DEFAULT.input_features + ["cycle_length"])


def test_nonchronological_bucketed_equals_plain_lag(spark):
    import random
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), rnd.randint(0, 40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "user_id long, day int, seq long") \
        .withColumn("cycle_start_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")))
    got = {r.user_id: r.n_inversions for r in quality.nonchronological_entities(df, "seq", bucket_width=7).collect()}
    w = Window.partitionBy("user_id").orderBy("seq")
    ref = df.withColumn("d", (F.lag("cycle_start_date").over(w) > F.col("cycle_start_date")).cast("long")) \
        .groupBy("user_id").agg(F.sum("d").alias("n")).filter("n > 0")
    assert got == {r.user_id: r.n for r in ref.collect()}


def test_daily_report_over_days_of_several_words(spark):
    """Long episodes, a day twice and another missing, days below 0, a null day; grouped by 64 days, not by day."""
    from pyspark.sql import functions as F
    rows = [episode(u, "2024-01-01", n, 5) for u, n in ((1, 130), (2, 130), (3, 70), (4, 64), (5, 65), (6, 3))]
    df = frame(spark, rows)
    daily, day, u = expand_days(add_history(df)), F.col("day_in_cycle"), F.col("user_id")
    daily = daily.withColumn("day_in_cycle", F.when((u == 2) & (day == 100), 99).when((u == 3) & (day == 0), -1)
                             .when((u == 6) & (day == 1), F.lit(None).cast("int")).otherwise(day))
    report = quality.daily_report(daily, df)
    got = {r["check"]: r["violations"] for r in report.collect()}
    assert got["episode_day_set"] == 2 and got["sample_date_increasing"] == 3 and got["daily_rows_equal_length_sum"] == 0
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "HashAggregate(keys=[" in line
                and any(k.strip().startswith("day_in_cycle#") for k in line.split("keys=[")[1].split("]")[0].split(","))]


def test_window_values_are_searched_whole(spark):
    from pyspark.sql import functions as F
    nan, inf = float("nan"), float("inf")
    ok = [[0.0, 3e38], [-1.0, 2.0]]
    cases = [(ok, [0.0, 1.0], 0), ([[0.0, nan], [1.0, 2.0]], [0.0, 1.0], 1), ([[0.0, 1.0], [None, 2.0]], [0.0, 1.0], 1),
             ([[0.0, 1.0], [2.0, inf]], [0.0, 1.0], 1), ([[-inf, 1.0], [2.0, 3.0]], [0.0, 1.0], 1), ([[None, None], [None, None]], [0.0, 1.0], 1),
             ([[0.0, nan], None], [0.0, 1.0], 1), ([[0.0, 1.0], None], [0.0, 1.0], 0), (ok, [0.0, None], 1), (ok, [nan, 0.0], 1),
             (ok, [-inf, 0.0], 1), (ok, [None, None], 1), (ok, [], 0), ([], [0.0, 1.0], 0), (ok, None, 0), (None, [0.0, 1.0], 0),
             (ok, [16777216.0, 16777216.0], 0), (ok, [3e38, 3.4028235e38], 0), ([[3.4028235e38, None], [0.0, 0.0]], [0.0], 1)]
    for kind in ("float", "double"):
        w = spark.createDataFrame([(i, x, r) for i, (x, r, _) in enumerate(cases)], f"i int, X array<array<{kind}>>, y_reg array<{kind}>") \
            .withColumns({"y_phase": F.array(F.lit(0)), "seq_length": F.lit(2)})
        bad = next(e for name, _, e in quality.window_checks(2, 2) if name == "non_finite_value")
        got = {r.i: r.v for r in w.groupBy("i").agg(bad.alias("v")).collect()}
        assert got == {i: n for i, (_, _, n) in enumerate(cases)}
    plan = quality.window_report(w, 2, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_max(flatten" in plan
