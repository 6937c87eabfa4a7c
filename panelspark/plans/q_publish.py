"""Catalog part 8 - audited, published stages and the reject channel of the CSV source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout, quality
from ..sources import io
from ..sources.store import StageStore
from ..sources.tables import EPISODES_SQL, EPOCH, episodes, with_views
from ..spec import DEFAULT as S
from .pipelines import daily_for_sink, day_partitions
from .q_builder import D, DAILY_COLUMNS_SQL
from .q_io import RAW_HEADERS, _scratch
from .registry import query
from .stages import build_daily, build_daily_from_csv, published

_K_SQL = f"(user_id * 1000 + datediff('day', DATE '{EPOCH}', cycle_start_date))"
_CELLS_LEFT = 9  # of a record that is cut
# column -> (key modulus, text put in); "NA" is a missing value and no fault
_FAULTS = {"age": (37, "forty"), "bmi": (43, "2x.5"), "sleep_hours": (31, "NA"), "cycle_start_date": (97, "not-a-date"),
           "cycle_length": (53, "28 days"), "next_cycle_start_date": (101, "2024-13-45")}
_CUT = 89


def faulty_csv(spark, sf) -> str:
    """The episodes as CSV text with unreadable cells and records that are cut."""
    k = F.col("user_id") * 1000 + F.datediff("cycle_start_date", F.lit(EPOCH).cast("date"))
    ep = episodes(spark, sf).withColumn("k", k)
    cells = {c: F.col(c).cast("string") for c in RAW_HEADERS}
    cells |= {c: F.when(F.col("k") % m == 0, text).otherwise(cells[c]) for c, (m, text) in _FAULTS.items()}
    record = F.array(*cells.values())
    line = F.array_join(F.when(F.col("k") % _CUT == 0, F.slice(record, 1, _CELLS_LEFT)).otherwise(record), ",")
    path = _scratch(spark, "faulty-csv")
    ep.select(line.alias(",".join(RAW_HEADERS.values()))).write.option("header", True).option("sep", "\u0001") \
        .option("quote", "").csv(path)
    return path


_START_TEXT = "CASE WHEN k % 97 = 0 THEN 'not-a-date' ELSE CAST(cycle_start_date AS VARCHAR) END"
_BAD = {c: f for c, f in _FAULTS.items() if f[1] != "NA"}
_REASON = {"age": "not a int", "bmi": "not a double", "cycle_start_date": "not a date", "cycle_length": "not a int",
           "next_cycle_start_date": "not a date"}
KEYED_SQL = f"keyed AS (SELECT *, {_K_SQL} AS k FROM episodes)"


@query("csv_rejects", with_views("\nUNION ALL\n".join(
    [f"SELECT CAST(user_id AS VARCHAR) AS user_id, {_START_TEXT} AS start, '{c}' AS column_name, '{text}' AS raw_value, "
     f"'{_REASON[c]}' AS reason FROM keyed WHERE k % {m} = 0 AND k % {_CUT} <> 0" for c, (m, text) in _BAD.items()]
    + [f"SELECT CAST(user_id AS VARCHAR), {_START_TEXT}, NULL, NULL, 'wrong number of cells' FROM keyed WHERE k % {_CUT} = 0"]),
    EPISODES_SQL, KEYED_SQL))
def q_csv_rejects(spark, sf):
    """SRC1, PRJ3: every cell and record of a faulty CSV that can't be read."""
    cells = F.split("raw_record", ",")
    found = io.rejects(io.typed_episodes(spark, faulty_csv(spark, sf)))
    return found.select(cells[0].alias("user_id"), cells[7].alias("start"), "column_name",
                        F.when(F.col("column_name").isNotNull(), F.col("raw_value")).alias("raw_value"), "reason")


_ANY_BAD = " OR ".join([f"k % {m} = 0" for m, _ in _BAD.values()] + [f"k % {_CUT} = 0"])


@query("csv_balance", with_views(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS rows_read, CAST(COUNT(*) FILTER (WHERE NOT ({_ANY_BAD})) AS BIGINT) AS rows_kept,
 CAST(COUNT(*) FILTER (WHERE {_ANY_BAD}) AS BIGINT) AS rows_rejected,
 CAST(COUNT(*) FILTER (WHERE NOT ({_ANY_BAD})) AS BIGINT) AS episodes_published,
 CAST(SUM(cycle_length) FILTER (WHERE NOT ({_ANY_BAD})) AS BIGINT) AS days_published,
 CAST(COUNT(*) FILTER (WHERE NOT ({_ANY_BAD}) AND k % 31 = 0) AS BIGINT) AS missing_sleep_hours
FROM keyed""", EPISODES_SQL, KEYED_SQL))
def q_csv_balance(spark, sf):
    """SRC1 -> SNK1 from the file to published tables: read = kept + rejected, and what was kept is what is published."""
    path = _scratch(spark, "from-csv")
    build_daily_from_csv(spark, faulty_csv(spark, sf), path, max_rejected=0.5)
    rows = StageStore(spark, path).manifest()["rows"]
    ep = published(spark, path, "episodes")
    counts = ep.agg(F.count(F.lit(1)).alias("episodes_published"), F.count_if(F.col("sleep_hours").isNull()).alias("missing_sleep_hours"))
    days = published(spark, path, "daily").agg(F.count(F.lit(1)).alias("days_published"))
    return counts.crossJoin(days).select(*[F.lit(rows[k]).cast("long").alias(f"rows_{k}") for k in ("read", "kept", "rejected")],
                                         "episodes_published", "days_published", "missing_sleep_hours")


@query("published_after_failure", D(f"SELECT {DAILY_COLUMNS_SQL} FROM daily"))
def q_published_after_failure(spark, sf):
    """SNK1 + DQ1-DQ6: a good panel is published; a second run with a broken episode fails its rules; what is published
    is still the first panel."""
    path = _scratch(spark, "published")
    ep = episodes(spark, sf)
    build_daily(ep, path)
    broken = ep.withColumn("period_length", F.when(F.col("user_id") % 7 == 0, F.col("cycle_length")).otherwise(F.col("period_length")))
    try:
        build_daily(broken, path)
    except quality.DataQualityError:
        return published(spark, path, "daily")
    raise AssertionError("the broken episodes were published")


@query("sink_order_check", D("""
SELECT layout, (SELECT COUNT(*) FROM daily) AS n_rows, layout = 'sink' AS rows_ascend, layout = 'sink' AS files_apart
FROM (VALUES ('sink'), ('shuffled')) v(layout)"""))
def q_sink_order_check(spark, sf):
    """SRT1: the files of the daily sink ascend by (entity, start, day) and don't overlap; a copy in the order
    of a hash does neither."""
    path, keys = _scratch(spark, "sink-order"), [S.entity, S.start, S.day]
    io.write_daily(daily_for_sink(episodes(spark, sf)), f"{path}/sink")
    order, sink = F.xxhash64(*keys), spark.read.parquet(f"{path}/sink")
    # rows in hash order compress badly, so they are shuffled in packs and the copy is written with zstd
    copy = layout.by_hash(sink, keys, max(4, day_partitions(sink.count(), spark)))
    copy.sortWithinPartitions(order).write.option("compression", "zstd").parquet(f"{path}/shuffled")
    found = [layout.order_report(spark, f"{path}/{name}", keys).select(
        F.lit(name).alias("layout"), "n_rows", (F.col("n_descents") == 0).alias("rows_ascend"),
        (F.col("n_overlaps") == 0).alias("files_apart")) for name in ("sink", "shuffled")]
    return found[0].unionAll(found[1])
