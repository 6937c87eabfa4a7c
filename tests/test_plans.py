"""Plan-shape tests and the oracle sweep on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_mod
from panelspark.plans.catalog import ORACLE, QUERIES
from panelspark.plans.pipelines import daily_panel
from panelspark.sources.tables import episodes

SF = "/root/testdata/sf0.001"
HAVE_DATA = os.path.exists(os.path.join(SF, "orders.parquet"))
pytestmark = pytest.mark.skipif(not HAVE_DATA, reason="driver tables not present")


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = {r["phase_label"]: r["n_rows"] for r in df.collect()}
    assert rows == {0: 7500, 1: 27814, 2: 1500, 3: 19500}


def test_daily_panel_has_no_python_and_no_shuffle_after_explode(spark):
    d = daily_panel(episodes(spark, SF))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # the explode is the last operator: nothing above it shuffles
    top = plan.split("Generate")[0]
    assert "Exchange" not in top


def test_windows_reuse_panel_partitioning(spark):
    from panelspark.operators.sequences import episode_rows
    d = daily_panel(episodes(spark, SF))
    plan = episode_rows(d)._jdf.queryExecution().executedPlan().toString()
    top = plan.split("Generate")[0]
    # grouping on (entity, start) reuses the history step's partitioning
    assert "Exchange" not in top


def test_scan_prunes_columns(spark):
    from panelspark.sources.tables import table
    plan = table(spark, SF, "lineitem").select("l_quantity").filter("l_quantity > 10") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_quantity:double>" in plan


def _norm_rows(cols, rows):
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "scripts"))
    from check_oracle import rows_of
    return rows_of(cols, rows)


# the library's own catalog; the optional corpus operators have a sweep of their own, over their tables
@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_duckdb(spark, duck, name):
    sdf = QUERIES[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(ORACLE[name])
    dcols = [c[0] for c in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _norm_rows(sdf.columns, srows) == _norm_rows(dcols, res.fetchall())


def test_every_query_has_oracle_or_is_a_model_fit():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only == {"phase_classifier", "countdown_regressor", "window_model", "batch_score", "sequence_forecast_report",
                         "experiment_reports"}
