"""Audited, published stages and the reject channel of the CSV source."""

import os

import pytest

from panelspark.operators import layout, quality
from panelspark.operators.quality import DataQualityError, Watched
from panelspark.plans.pipelines import prepared_episodes
from panelspark.plans.stages import build_daily, build_daily_from_csv, build_splits, build_windows, published
from panelspark.sources import io, store
from panelspark.sources.store import StageStore, StaleStageError, publishing

from helpers import F, episode, frame


def _eps(n=30):
    return [e for u in range(1, n + 1) for e in (episode(u, "2024-01-01", 22 + u % 9, 3 + u % 3),
                                                 episode(u, "2024-03-01", 25 + u % 4, 4))]


def _rows(df):
    return sorted(map(str, df.collect()))


def test_a_failed_rule_leaves_every_stage_as_it_was(spark, tmpdir_path):
    a, b, c = (f"{tmpdir_path}/{x}" for x in "abc")
    daily = build_daily(frame(spark, _eps()), a)
    panel = build_splits(daily, b)
    build_windows(panel, c, [14, 21])
    tables = [(a, "episodes"), (a, "daily"), (b, "membership"), (b, "scaler"), (b, "splits"), (c, "windows")]
    before = {t: _rows(published(spark, *t)) for t in tables}
    manifests = {p: StageStore(spark, p).manifest() for p in (a, b, c)}
    with pytest.raises(DataQualityError, match="prefix_below_length"):
        build_daily(frame(spark, [*_eps(), episode(90, "2024-01-01", 28, 30)]), a)
    with pytest.raises(DataQualityError, match="episode_day_set"):  # found when the days are already written
        build_daily(frame(spark, [*_eps(), episode(1, "2024-01-01", 23, 4)]), a)
    with pytest.raises(DataQualityError, match="n_non_binary"):
        build_splits(daily.withColumn("diet_balanced", F.lit(2)), b)
    with pytest.raises(DataQualityError, match="label_domain_21"):
        build_windows(panel.withColumn("phase_label", F.lit(7)), c, 21)
    assert {t: _rows(published(spark, *t)) for t in tables} == before
    assert {p: StageStore(spark, p).manifest() for p in (a, b, c)} == manifests
    assert _rows(daily) == before[a, "daily"]


def test_a_lost_job_leaves_no_half_stage(spark, tmpdir_path, monkeypatch):
    daily = build_daily(frame(spark, _eps()), tmpdir_path)

    def dies(panel, path, spec):  # with half of the days written
        panel.filter("day_in_cycle < 10").write.parquet(path)
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
        m.setattr(io, "write_daily", dies)
        build_daily(frame(spark, _eps(40)), tmpdir_path)
    at = StageStore(spark, tmpdir_path)
    assert at.numbers() == [1] and at.read("daily").count() == daily.count()
    assert len(os.listdir(f"{tmpdir_path}/versions")) == 2
    assert len(at.vacuum()) == 1  # the half version
    assert os.listdir(f"{tmpdir_path}/versions") == [at.manifest()["version"]] and daily.count() == at.read("daily").count()


def test_nothing_published_is_an_error_of_the_reader(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError):
        published(spark, f"{tmpdir_path}/none", "daily")
    with pytest.raises(DataQualityError):
        build_daily(frame(spark, [episode(1, "2024-01-01", 28, 30)]), tmpdir_path)
    assert StageStore(spark, tmpdir_path).manifest() is None


def test_versions_stay_until_vacuum(spark, tmpdir_path):
    first = build_daily(frame(spark, _eps(3)), tmpdir_path)
    old = _rows(first)
    second = build_daily(frame(spark, _eps(5)), tmpdir_path)
    at = StageStore(spark, tmpdir_path)
    assert _rows(first) == old == _rows(at.read("daily", 1)) and _rows(at.read("daily")) == _rows(second)
    build_daily(frame(spark, _eps(6)), tmpdir_path)
    gone = at.vacuum(keep=1)
    assert len(gone) == 2 and at.numbers() == [3] and at.read("episodes").count() == 12


def test_the_second_of_two_writers_fails(spark, tmpdir_path):
    with pytest.raises(StaleStageError), publishing(spark, tmpdir_path) as slow:
        frame(spark, _eps(1)).write.parquet(slow.path("t"))
        with publishing(spark, tmpdir_path) as fast:
            frame(spark, _eps(2)).write.parquet(fast.path("t"))
    assert published(spark, tmpdir_path, "t").count() == 4


def test_checks_are_in_the_manifest(spark, tmpdir_path):
    build_daily(frame(spark, [*_eps(2), episode(7, "2024-01-01", 20, 6)]), tmpdir_path)  # ovulation on the last period day
    checks = {c["check"]: (c["severity"], c["violations"]) for c in StageStore(spark, tmpdir_path).manifest()["checks"]}
    assert checks["phase_overlap"] == ("warn", 1) and checks["daily_rows_equal_length_sum"] == ("error", 0)


def test_watched_checks_equal_the_report(spark, tmpdir_path):
    bad = [episode(90, "2024-01-01", 28, 30), episode(91, "2024-01-01", 28, 5, ex="Extreme"), episode(None, "2024-01-01", 28, 5)]
    ep = prepared_episodes(frame(spark, _eps() + bad))
    seen = Watched(ep, quality.episode_checks() + quality.encoding_checks(), days=F.sum("cycle_length"))
    seen.rows.repartition(3).write.parquet(f"{tmpdir_path}/x")
    assert sorted(seen.results()) == sorted(quality.results_of(quality.episode_report(ep)))
    assert seen.measured("days") == ep.agg(F.sum("cycle_length")).first()[0]
    none = Watched(ep.filter(F.col("user_id") > 1000), quality.episode_checks())
    none.rows.write.parquet(f"{tmpdir_path}/y")
    assert {v for _, _, v in none.results()} == {0}


def test_windows_are_audited_without_reading_them(spark, tmpdir_path, monkeypatch):
    panel = build_splits(build_daily(frame(spark, _eps()), f"{tmpdir_path}/a"), f"{tmpdir_path}/b")
    monkeypatch.setattr(io, "read_windows", lambda *a, **k: pytest.fail("read again"))
    meta = build_windows(panel, f"{tmpdir_path}/c", [14, 21])
    assert sum(r.n_windows for r in meta.collect()) == published(spark, f"{tmpdir_path}/c", "windows").count()
    with pytest.raises(DataQualityError, match="unknown_split"):
        build_windows(panel.withColumn("split", F.lit("other")), f"{tmpdir_path}/d", 14)


def test_a_contract_survives_a_failed_update(spark, tmpdir_path, monkeypatch):
    path = f"{tmpdir_path}/contract"
    io.write_contract(spark, path)
    before = io.read_contract(spark, path)
    with monkeypatch.context() as m:
        m.setattr(store._Files, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            io.update_contract(spark, path, {"stage": "scaled"})
    assert io.read_contract(spark, path) == before
    for n in range(12):
        io.update_contract(spark, path, {"stage": str(n)})
    assert io.read_contract(spark, path) == {**before, "stage": "11"}


# --- physical order ---------------------------------------------------------------------------

@pytest.mark.parametrize("block", [3, 1 << 18])
def test_order_of_files(spark, tmpdir_path, block):
    keys = ["a", "b"]

    def report(name, *files):
        for rows in files:
            spark.createDataFrame(rows, "a long, b long").coalesce(1).write.mode("append").parquet(f"{tmpdir_path}/{name}")
        return tuple(layout.order_report(spark, f"{tmpdir_path}/{name}", keys, block).first())

    up = [(1, i) for i in range(10)]
    assert report("one", up) == (10, 1, 0, 0)
    assert report("two", up, [(1, 9), (1, 9), (2, 0)]) == (13, 2, 0, 0)  # a key that goes on
    assert report("over", up, [(1, 4), (3, 0)]) == (12, 2, 0, 1)
    assert report("inside", up, [(1, 4), (1, 5)], [(1, 6)]) == (13, 3, 0, 2)
    assert report("down", [(2, 0), *up, (0, 0), (None, 5), (0, 1)]) == (14, 1, 3, 0)
    assert report("none", []) == (0, 0, 0, 0)


def test_order_of_files_by_keys_of_other_kinds(spark, tmpdir_path):
    """Nulls first, NaN last, texts by bytes; rows of a file are not shuffled."""
    nan = float("nan")
    rows = [(None, "z", 5.0), ("B", None, 1.0), ("B", "a", None), ("B", "a", -1.0), ("B", "a", 2.0), ("B", "a", nan), ("a", "a", 0.0), ("é", "a", 0.0)]
    schema = "s string, t string, x double"
    for name, order in (("up", rows), ("down", rows[::-1])):
        spark.createDataFrame(order, schema).coalesce(1).write.parquet(f"{tmpdir_path}/{name}")
    up, down = (layout.file_order(spark, f"{tmpdir_path}/{n}", ["s", "t", "x"]) for n in ("up", "down"))
    assert (up.first().n_descents, down.first().n_descents) == (0, 7)
    for found in (up.first(), down.first()):
        assert (found.n_rows, tuple(found.first_key), tuple(found.last_key)) == (8, (None, "z", 5.0), ("é", "a", 0.0))
    plan = up._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "Exchange" not in below and "Sort" not in below


# --- reject channel ---------------------------------------------------------------------------

HEADER = "User ID,Age,BMI,Stress Level,Exercise Frequency,Sleep Hours,Diet,Cycle Start Date,Cycle Length,Period Length,Next Cycle Start Date,Symptoms,Note"
GOOD = "1,30,22.5,2,Low,7.0,Balanced,2024-01-01,28,5,2024-01-29,Cramps,"


def _csv(tmpdir_path, *lines, name="a"):
    os.makedirs(f"{tmpdir_path}/csv", exist_ok=True)
    with open(f"{tmpdir_path}/csv/{name}.csv", "w") as f:
        f.write("\n".join(lines) + "\n")
    return f"{tmpdir_path}/csv"


def test_rejects_name_each_cell(spark, tmpdir_path):
    path = _csv(tmpdir_path, HEADER, GOOD, '2, 31 ,NA,2,Low,7.5,Balanced,2024-01-01,28,5,01/29/2024,"Cramps, ""bad""",x',
                "x,1e3,inf,2,Low,7.0,Balanced,2024-01-32,28 days,5,,Cramps,y", "3,30", GOOD + ",14,15", ",,,,,,,2024-01-01,28,5,2024-01-29,,",
                "9999999999999999999,30,22.5,2,Low,7,Balanced,2024-01-01,28,5,2024-01-29,Cramps,")
    typed = io.typed_episodes(spark, path)
    kept = io.accepted(typed).collect()
    assert [(r.user_id, r.age, r.bmi, r.symptoms, r.note) for r in kept] == [
        (1, 30, 22.5, "Cramps", None), (2, 31, None, 'Cramps, "bad"', "x"), (None, None, None, None, None)]
    assert [str(r.next_cycle_start_date) for r in kept] == ["2024-01-29"] * 3
    bad = [(r.column_name, r.raw_value, r.reason) for r in io.rejects(typed).collect()]
    assert sorted(bad, key=str) == sorted([
        ("user_id", "x", "not a bigint"), ("age", "1e3", "not a int"), ("bmi", "inf", "not finite"),
        ("cycle_start_date", "2024-01-32", "not a date"), ("cycle_length", "28 days", "not a int"),
        (None, "3,30", "wrong number of cells"), (None, GOOD + ",14,15", "wrong number of cells"),
        ("user_id", "9999999999999999999", "not a bigint")], key=str)
    raws = {r.raw_record for r in io.rejects(typed).collect()}
    assert len(raws) == 4 and any(r.startswith("x,1e3,inf") for r in raws)
    assert typed.count() == len(kept) + len(raws)
    assert all(r.source_file.endswith("/csv/a.csv") for r in io.rejects(typed).collect())
    assert {(r.column_name, r.reason): r.n_cells for r in io.reject_counts(typed).collect()}["user_id", "not a bigint"] == 2


def test_csv_without_rows_or_with_other_headers(spark, tmpdir_path):
    path = _csv(tmpdir_path, HEADER)
    assert io.typed_episodes(spark, path).count() == 0 and io.rejects(io.typed_episodes(spark, path)).collect() == []
    with pytest.raises(ValueError, match="symptoms"):
        io.typed_episodes(spark, _csv(f"{tmpdir_path}/b", HEADER.replace(",Symptoms", "")))
    with pytest.raises(Exception, match="header|conform"):
        io.typed_episodes(spark, _csv(tmpdir_path, HEADER.replace("Age,BMI", "BMI,Age"), GOOD, name="b")).collect()


def test_from_csv_to_published_tables(spark, tmpdir_path):
    lines = [",".join(map(str, (*e[:7], e[7], *e[8:11], e[11], ""))) for e in _eps(20)]
    path = _csv(tmpdir_path, HEADER, *lines, "77,old,22.5,2,Low,7.0,Balanced,2024-01-01,28,5,2024-01-29,Cramps,")
    daily = build_daily_from_csv(spark, path, f"{tmpdir_path}/a")
    assert _rows(daily) == _rows(build_daily(frame(spark, _eps(20)), f"{tmpdir_path}/b"))
    manifest = StageStore(spark, f"{tmpdir_path}/a").manifest()
    assert manifest["rows"] == {"read": 41, "kept": 40, "rejected": 1}
    assert published(spark, f"{tmpdir_path}/a", "rejects").first().raw_value == "old"
    with pytest.raises(DataQualityError, match="too_many_rejects"):
        build_daily_from_csv(spark, path, f"{tmpdir_path}/a", max_rejected=0.01)
    assert StageStore(spark, f"{tmpdir_path}/a").manifest() == manifest
