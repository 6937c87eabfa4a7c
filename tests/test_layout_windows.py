"""Windows from blocks with an edge, windows as slices, bucketed panels."""

import uuid

import pytest

from panelspark.operators import sequences
from panelspark.plans.pipelines import daily_panel
from panelspark.sources import io

from helpers import F, episode, frame


def _events(spark, sizes):
    rows = [(g, i // 7, i, (i * 37) % 101) for g, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "g string, d long, i long, v long").repartition(5, "v")


def _found(df, L, block=None):
    w = sequences.windows_by_position(df, ["g"], "d", ["i"], L, {"i": "i", "v": "v"}, block)
    return sorted((r.g, r.window_start, r.seq_length, [(x.p, x.i, x.v) for x in r.win]) for r in w.collect())


@pytest.mark.parametrize(("L", "block"), [(1, 3), (3, 3), (3, 4), (5, 7), (5, None), (21, 32)])
def test_block_windows_equal_plain_slices(spark, L, block):
    sizes = {"a": 70, "b": L, "c": L - 1, "d": 1, "e": 2 * (block or 256) + L - 1, "f": 2 * (block or 256)}
    want = [(g, s, L, [(i, i, (i * 37) % 101) for i in range(s, s + L)]) for g, n in sizes.items() for s in range(n - L + 1)]
    assert _found(_events(spark, sizes), L, block) == sorted(want)


def test_rows_are_shuffled_once_and_a_little(spark):
    n, L = 20_000, 21
    df = spark.range(n).select(F.lit("hot").alias("g"), F.floor(F.col("id") / 10).alias("d"), F.col("id").alias("i"), F.col("id").alias("v"))
    block = max(256, 16 * L)
    copies = sum(1 + (p % block < L - 1 and p >= block) for p in range(n))
    assert copies <= 1.1 * n
    w = sequences.windows_by_position(df, ["g"], "d", ["i"], L, {"v": "v"})
    assert w.agg(F.count(F.lit(1)), F.sum("window_start"), F.sum(F.element_at("win", -1)["v"])).first()[:] == (
        n - L + 1, (n - L) * (n - L + 1) // 2, sum(range(L - 1, n)))


def _panel(spark):
    eps = [episode(u, f"2024-0{m}-01", 22 + (u * m) % 9, 3 + u % 3) for u in range(1, 20) for m in (1, 3)]
    return daily_panel(frame(spark, eps)).withColumn("split", F.lit("train"))


def test_grouping_a_bucketed_panel_needs_no_exchange(spark, tmpdir_path):
    panel, a, b = _panel(spark), f"t{uuid.uuid4().hex}", f"t{uuid.uuid4().hex}"
    want = sorted(map(str, sequences.windows(sequences.episode_rows(panel), [14, 21]).collect()))
    try:
        first = io.write_bucketed(panel, a, f"{tmpdir_path}/p", 4)
        again = io.open_bucketed(spark, b, f"{tmpdir_path}/p", 4)
        for table in (first, again):
            rows = sequences.episode_rows(table)
            assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, sequences.windows(rows, [14, 21]).select(*sequences.windows(sequences.episode_rows(panel), 14).columns).collect())) == want
    finally:
        for t in (a, b):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_partitions_follow_the_days_not_the_bytes_of_episodes(spark, monkeypatch):
    from panelspark.plans import pipelines
    eps = frame(spark, [episode(u, f"2024-0{m}-01", 22 + (u * m) % 9, 3) for u in range(1, 40) for m in (1, 3)])
    days = pipelines.days_of(eps)
    assert days == eps.agg(F.sum("cycle_length")).first()[0]
    monkeypatch.setattr(pipelines, "DAYS_PER_TASK", 64)
    want = -(-days // 64)
    for panel in (pipelines.daily_for_sink(eps), pipelines.split_daily(eps), pipelines.split_and_scale(eps)[0], pipelines.window_source(eps)):
        parts = panel.groupBy(F.spark_partition_id()).count().count()
        assert want / 2 < parts <= want  # some may be empty
    assert pipelines.day_partitions(None, spark) == spark.sparkContext.defaultParallelism
