"""Session helpers.

On a cluster the session is created by the platform; these helpers only fill
in settings that are unset (tests, bench), never override a cluster's.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.driver.host": "127.0.0.1",
    "spark.driver.bindAddress": "127.0.0.1",
    "spark.driver.memory": "8g",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # explode-heavy stages (days x 37, windows x 18) read small episode shuffles:
    # size partitions for the work after the shuffle, not for its input bytes
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # checkpoint files of a finished plan are removed when their frame is collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", app: str = "panelspark", **extra) -> SparkSession:
    """Local session for tests and the bench (the UI stays off)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**LOCAL_CONF, **extra}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only when the session names none (local tests, bench) a scratch folder is
    used: the context's current one if it has one, else a new temp folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - e.g. a Connect session: the server applies the conf
        return named or ""
    current = sc.getCheckpointDir()
    if named:
        if not current or named.rstrip("/") not in current:
            sc.setCheckpointDir(named)
        return named
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="panelspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def materialize(df):
    """Reliable checkpoint into the shared checkpoint folder.

    Used where one intermediate table feeds several branches of a plan (split
    membership, scaler fit, transform): it is computed once instead of once per
    branch, and a lost executor re-reads it instead of replaying the lineage.
    The checkpointed frame keeps its partitioning, so later groupings on the
    same keys still need no shuffle.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
