"""Inputs that used to lose rows, columns or cells."""

import datetime as dt


from panelspark.operators import clean, evaluate, scale
from panelspark.sources import io
from panelspark.spec import DEFAULT, PanelSpec, snake


def test_report_with_many_rows_per_file_comes_back(spark, tmpdir_path):
    rows = [(f"run{i % 2}", f"m{i}", float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "experiment string, metric string, value double").coalesce(1)
    io.write_report(df, tmpdir_path + "/reports")
    back = io.read_reports(spark, tmpdir_path + "/reports").select("experiment", "metric", "value")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_date_forms(spark):
    forms = ["2024-01-05T10:30:00", "2024-01-05 10:30", "2024-01-05 10:30:00.250", "20240105", "2024-1-5", "Jan 5, 2024",
             "2024/01/05", "01/05/2024", "05.01.2024"]
    df = spark.createDataFrame([(f,) for f in forms] + [("never",), ("2024-13-45",), (None,)], "d string")
    got = [r.p for r in df.select(clean.parse_date("d").alias("p")).collect()]
    assert got == [dt.date(2024, 1, 5)] * len(forms) + [None] * 3


def test_null_cell_does_not_hide_its_row(spark):
    df = spark.createDataFrame([("val", 5.0, None)], "split string, a double, b double")
    r = scale.range_report(df, ["a", "b"], DEFAULT, targets=[]).first()
    assert (r.n_out_of_range, r.n_null_scaled) == (1, 1)


def test_zero_weight_group_gives_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.0)], "y double, p double, w double")
    assert evaluate.regression_error(df, "y", "p", weight="w").first().mae is None


def test_context_columns_of_another_panel():
    spec = PanelSpec(static_numeric=("weight", "severity"))
    assert {"weight", "severity"} <= set(spec.daily_columns)


def test_snake():
    names = ["  A b ", "A_ _B", "_x", "Was it? (yes)", "a  -  b", "Größe 2"]
    assert [snake(n) for n in names] == ["a_b", "a_b", "_x", "was_it_yes", "a_b", "größe_2"]


