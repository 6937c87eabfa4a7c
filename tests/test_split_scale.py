import pytest
from pyspark.sql import functions as F

from panelspark.operators import scale, split


def _ents(spark, n):
    return spark.range(n).select((F.col("id") * 7 + 3).alias("user_id"))


@pytest.mark.parametrize("n,expected", [(10, (7, 2, 1)), (30, (21, 4, 5)), (50, (35, 8, 7)),
                                        (100, (70, 15, 15))])
def test_h7_split_sizes(spark, n, expected):
    m = split.split_membership(_ents(spark, n))
    c = {r["split"]: r["count"] for r in m.groupBy("split").count().collect()}
    assert (c.get("train", 0), c.get("val", 0), c.get("test", 0)) == expected


def test_split_is_disjoint_complete_and_partition_invariant(spark):
    e = _ents(spark, 500)
    a = {r.user_id: r.split for r in split.split_membership(e).collect()}
    b = {r.user_id: r.split for r in split.split_membership(e.repartition(13)).collect()}
    assert a == b and len(a) == 500
    ov = {r["pair"]: r["n_entities"] for r in split.split_overlap(split.split_panel(e)).collect()}
    assert ov["train&val"] == ov["train&test"] == ov["val&test"] == 0 and ov["covered"] == 500


def test_row_local_assignment_equals_membership_join(spark):
    e = _ents(spark, 300)
    panel = e.crossJoin(spark.range(3).withColumnRenamed("id", "day"))
    m = split.split_membership(e)
    joined = panel.join(m.select("user_id", F.col("split").alias("s2")), "user_id")
    got = split.assign_split(joined, split.split_cuts(m))
    assert got.filter(F.col("split") != F.col("s2")).count() == 0


def test_ratios_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        split.split_membership(_ents(spark, 10), ratios=(0.7, 0.2, 0.2))


def test_extreme_ratios_never_overshoot(spark):
    m = split.split_membership(_ents(spark, 3), ratios=(0.5, 0.5, 0.0))
    c = {r["split"]: r["count"] for r in m.groupBy("split").count().collect()}
    assert sum(c.values()) == 3 and c.get("test", 0) >= 0


def test_h8_scaling(spark):
    rows = [("train", 2.0, 5.0), ("train", 4.0, 5.0), ("train", 6.0, 5.0), ("val", 8.0, 7.0)]
    df = spark.createDataFrame(rows, "split string, a double, b double")
    p = scale.fit_minmax(df, ["a", "b"], fit_filter=F.col("split") == "train")
    out = scale.apply_minmax(df, p, ["a", "b"]).orderBy("a").collect()
    assert [r.a for r in out] == [0.0, 0.5, 1.0, 1.5]
    assert [r.b for r in out] == [0.0, 0.0, 0.0, 2.0]
    rep = scale.range_report(scale.apply_minmax(df, p, ["a", "b"]), ["a", "b"], targets=[]).collect()
    oor = {r["split"]: r["n_out_of_range"] for r in rep}
    assert oor == {"train": 0, "val": 2}
    back = scale.inverse_minmax(scale.apply_minmax(df, p, ["a"]), p, ["a"]).orderBy("a").collect()
    assert [r.a for r in back] == [2.0, 4.0, 6.0, 8.0]


def test_missing_scale_column_is_an_error(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    with pytest.raises(ValueError):
        scale.fit_minmax(df, ["a", "zz"])
