import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import profile

VALS = [3.0, 7.0, 7.5, 1.0, 12.0, 4.0, 4.0, 9.0, 30.0, 2.0, 5.5]


def _df(spark):
    return spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(VALS)], "x double, g int")


def test_describe_matches_pandas_conventions(spark):
    r = profile.describe(_df(spark), ["x"]).first()
    a = np.array(VALS)
    assert r["count"] == len(VALS)
    assert r["std"] == np.round(a.std(ddof=1), 2)
    assert r["p25"] == np.round(np.percentile(a, 25), 2)
    assert r["p75"] == np.round(np.percentile(a, 75), 2)


def test_histogram_matches_numpy(spark):
    h = profile.histogram(_df(spark), ["x"], 20).orderBy("bin").collect()
    counts, edges = np.histogram(np.array(VALS), bins=20)
    assert [r["n"] for r in h] == counts.tolist()
    assert h[0]["bin_lo"] == pytest.approx(edges[0]) and h[-1]["bin_hi"] == pytest.approx(edges[-1])


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    h = profile.histogram(df, ["x"], 20).filter("n > 0").collect()
    counts, _ = np.histogram(np.array([5.0, 5.0]), bins=20)
    assert h[0]["bin"] == int(np.argmax(counts))


def test_boxplot_whiskers(spark):
    r = profile.boxplot_stats(_df(spark), ["x"]).first()
    a = np.array(VALS)
    q1, q3 = np.percentile(a, [25, 75])
    iqr = q3 - q1
    assert r["whisker_hi"] == a[a <= q3 + 1.5 * iqr].max()
    assert r["whisker_lo"] == a[a >= q1 - 1.5 * iqr].min()
    assert r["n_outliers"] == int(((a < q1 - 1.5 * iqr) | (a > q3 + 1.5 * iqr)).sum())


def test_pearson_constant_column_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 6.3, 5.0)], "a double, b double, c double")
    r = {(x.column_a, x.column_b): x.r for x in profile.pearson_matrix(df, ["a", "b", "c"]).collect()}
    assert r[("b", "a")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 6.3])[0, 1], abs=1e-6)
    assert r[("c", "a")] is None


def test_missing_counts_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    m = {r.column_name: (r.n_missing, r.pct_missing) for r in profile.missing_values(df).collect()}
    assert m["x"] == (2, 66.67) and m["s"] == (1, 33.33)


def test_duplicate_rows_and_static_check(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "user_id long, s string")
    assert profile.duplicate_rows(df).first()[0] == 1
    r = profile.static_feature_check(df, ["s"]).first()
    assert r["max_unique_values_per_user"] == 2


def test_duplicate_rows_are_compared_in_full(spark):
    rows = [(1, None, "a", 0.0), (1, "a", None, 0.0), (None, "x", None, -0.0), (None, "x", None, 0.0), (2, "", "", float("nan")),
            (2, "", "", float("nan")), (2, None, "", float("nan"))] + [(9, "hot", "hot", 1.5)] * 400 + [(i, "s", "t", 0.5) for i in range(100, 300)]
    df = spark.createDataFrame(rows, "user_id long, s string, __c string, x double").repartition(5)
    want = 1 + 1 + 399
    whole = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1)).first()[0]
    assert whole == want
    assert profile.duplicate_rows(df).first()[0] == want
    assert profile.duplicate_rows(df, broadcast_up_to=0).first()[0] == want  # joined by a shuffle
    assert profile.duplicate_rows(df.limit(0)).first()[0] == 0


def test_fingerprints_decide_nothing_alone(spark, monkeypatch):
    df = spark.createDataFrame([(i % 7, "x") for i in range(50)] + [(i, "y") for i in range(20)], "user_id long, s string")
    want = profile.duplicate_rows(df).first()[0]
    assert want == 43
    monkeypatch.setattr(profile.F, "xxhash64", lambda *c: F.lit(1).cast("bigint"))  # all rows share one fingerprint
    assert profile.duplicate_rows(df).first()[0] == want


def test_entity_stats_of_another_panel(spark):
    df = spark.createDataFrame([(1, 10, 2, 4.0), (1, 20, 4, 5.0), (2, 7, 1, None)],
                               "user_id long, cycle_length int, period_length int, dose double")
    got = {r.user_id: r.asDict() for r in profile.entity_stats(df, means={"mean_dose": "dose"}).collect()}
    assert got[1]["mean_dose"] == 4.5 and got[2]["mean_dose"] is None and got[2]["std_cycle_length"] == 0.0
    assert "mean_stress" not in got[1]


def test_top_k_ties_by_id(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 2.0), (2, 2.0)], "user_id long, s double")
    assert [r.user_id for r in profile.top_k(df, "s", 2, "user_id").collect()] == [1, 2]
    assert F is not None


def test_describe_approx_close_to_exact(spark):
    df = spark.range(2001).select((F.col("id") * 0.5).alias("x"))
    exact = profile.describe(df, ["x"]).first()
    approx = profile.describe_approx(df, ["x"]).first()
    for k in ("p25", "p50", "p75"):
        assert abs(exact[k] - approx[k]) <= 1.0
    assert exact["count"] == approx["count"] == 2001


def test_merged_comoments_equal_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 60)) @ rng.normal(size=(60, 60)) + 1e6 * np.arange(60)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7], x[:, 8], x[:, 9] = 0.1, np.nan, 1e9 + rng.normal(size=500)
    cols = [f"c{i}" for i in range(60)]
    df = spark.createDataFrame([tuple(None if i % 2 and np.isnan(v) else float(v) for i, v in enumerate(row)) for row in x],
                               ", ".join(f"{c} double" for c in cols)).repartition(7)
    got = {(r.column_a, r.column_b): r.r for r in profile.pearson_from_comoments(df, cols).collect()}
    assert len(got) == 60 * 59 // 2
    for i in range(60):
        for j in range(i):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            r = got[cols[i], cols[j]]
            if {i, j} & {7, 8}:
                assert r is None
            else:
                assert abs(r - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 2e-6


def test_comoments_of_few_rows_and_none(spark):
    df = spark.createDataFrame([(1.0, 2), (2.0, 4), (None, 5), (4.0, None)], "a double, b int")
    assert [tuple(r) for r in profile.pearson_from_comoments(df, ["a", "b"]).collect()] == [("b", "a", 1.0)]
    none = profile.pearson_from_comoments(df.limit(0), ["a", "b"]).collect()
    assert [r.r for r in none] in ([], [None])
    want = {tuple(r) for r in profile.pearson_matrix(df, ["a", "b"]).collect()}
    assert want == {("b", "a", 1.0)}
