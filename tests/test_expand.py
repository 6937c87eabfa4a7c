import pytest
from pyspark.sql import functions as F

from helpers import episode, frame, rows_by
from panelspark.operators.expand import expand_days
from panelspark.operators.history import add_history
from panelspark.operators.quality import episode_report
from panelspark.plans.pipelines import daily_panel


def _days(spark, rows):
    return rows_by(expand_days(add_history(frame(spark, rows))), "day_in_cycle")


def test_h3_expansion(spark):
    r = _days(spark, [episode(1, "2024-01-01", 28, 5, "2024-01-29")])
    assert len(r) == 28
    assert r[0]["days_until_next_cycle"] == 28
    assert r[14]["phase_name"] == "ovulation" and r[14]["phase_label"] == 2
    assert str(r[27]["sample_date"]) == "2024-01-28"
    assert r[27]["days_until_next_cycle"] == 1 and r[27]["phase_name"] == "luteal"


def test_h4_no_follicular(spark):
    r = _days(spark, [episode(1, "2024-01-01", 18, 4)])
    labels = [x["phase_label"] for x in r]
    assert labels[:4] == [0] * 4 and labels[4] == 2 and labels[5:] == [3] * 13
    rep = {x["check"]: x["violations"] for x in episode_report(frame(spark, [episode(1, "2024-01-01", 18, 4)]),
                                                               encoded=False).collect()}
    assert rep["phase_overlap"] == 1


def test_h5_no_ovulation(spark):
    r = _days(spark, [episode(1, "2024-01-01", 17, 5)])
    labels = [x["phase_label"] for x in r]
    assert labels[:5] == [0] * 5 and labels[5:] == [3] * 12


def test_h16_negative_countdown(spark):
    r = _days(spark, [episode(1, "2024-01-01", 30, 5, "2024-01-29")])
    assert r[28]["days_until_next_cycle"] == 0 and r[29]["days_until_next_cycle"] == -1


def test_non_positive_length_fails_instead_of_dropping(spark):
    with pytest.raises(Exception, match="episode length must be positive"):
        expand_days(add_history(frame(spark, [episode(1, "2024-01-01", 0, 0)]))).collect()


def test_length_of_any_integer_type(spark):
    ep = add_history(frame(spark, [episode(1, "2024-01-01", 28, 5)]))
    narrow = expand_days(ep)
    for kind in ("bigint", "smallint", "decimal(12,0)"):
        wide = expand_days(ep.withColumn("cycle_length", F.col("cycle_length").cast(kind)))
        assert dict(wide.dtypes)["day_in_cycle"] == "int"
        assert [tuple(r) for r in wide.drop("cycle_length").orderBy("day_in_cycle").collect()] == \
            [tuple(r) for r in narrow.drop("cycle_length").orderBy("day_in_cycle").collect()]
    with pytest.raises(Exception, match="fit an integer"):
        expand_days(ep.withColumn("cycle_length", F.lit(2**40))).collect()


def test_daily_rows_equal_sum_of_lengths(spark):
    rows = [episode(u, "2024-01-01", 20 + u, 3) for u in range(1, 30)]
    d = daily_panel(frame(spark, rows))
    assert d.count() == sum(20 + u for u in range(1, 30))
