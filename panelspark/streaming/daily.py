"""Streaming form of entry A: episodes arrive as files, the daily panel is appended.

The history features (WIN1-WIN3) need every earlier episode of an entity; in
a stream that is per-entity state of four numbers (sum and count of length
and prefix), kept by ``applyInPandasWithState``.  Encoding and the day
expansion are stateless and run on the streaming frame unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import (DateType, DoubleType, IntegerType, LongType, StructField, StructType)

from ..operators.encode import encode_categories
from ..operators.expand import expand_days
from ..spec import DEFAULT, PanelSpec

STATE_SCHEMA = StructType([
    StructField("sum_len", LongType()), StructField("n_len", LongType()),
    StructField("sum_pre", LongType()), StructField("n_pre", LongType()),
    StructField("n_rows", LongType()), StructField("last_start", DateType()),
])


def _history_schema(src: StructType, spec: PanelSpec) -> StructType:
    extra = [StructField(spec.hist_length, DoubleType()), StructField(spec.hist_prefix, DoubleType()),
             StructField(spec.cold_flag, IntegerType()), StructField("n_prior_episodes", LongType()),
             StructField("late_episode", IntegerType())]
    return StructType(list(src.fields) + extra)


def stateful_history(episodes: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """WIN1-WIN3 on a stream: the same numbers as :func:`operators.history.add_history`
    when each entity's episodes arrive in start order; an episode older than the
    entity's latest seen start is flagged ``late_episode = 1`` (DQ7 on a stream)."""
    import numpy as np
    import pandas as pd

    out_schema = _history_schema(episodes.schema, spec)
    cols = [f.name for f in episodes.schema.fields]
    tie = [spec.start, spec.next_start, spec.length, spec.prefix]

    def rint2(x):
        return np.rint(x * 100.0) / 100.0

    def update(key, batches, state):
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(tie, kind="mergesort")
        if state.exists:
            s_len, n_len, s_pre, n_pre, n_rows, last = state.get
        else:
            s_len = n_len = s_pre = n_pre = n_rows = 0
            last = None
        L = pdf[spec.length].astype("float64").to_numpy()
        P = pdf[spec.prefix].astype("float64").to_numpy()
        okL, okP = ~np.isnan(L), ~np.isnan(P)
        cL = np.concatenate([[0.0], np.cumsum(np.where(okL, L, 0.0))[:-1]]) + s_len
        kL = np.concatenate([[0], np.cumsum(okL)[:-1]]) + n_len
        cP = np.concatenate([[0.0], np.cumsum(np.where(okP, P, 0.0))[:-1]]) + s_pre
        kP = np.concatenate([[0], np.cumsum(okP)[:-1]]) + n_pre
        with np.errstate(invalid="ignore", divide="ignore"):
            mL = np.where(kL > 0, cL / np.maximum(kL, 1), np.nan)
            mP = np.where(kP > 0, cP / np.maximum(kP, 1), np.nan)
        out = pdf[cols].copy()
        out[spec.cold_flag] = (np.isnan(mL) | np.isnan(mP)).astype("int32")
        out[spec.hist_length] = rint2(np.where(np.isnan(mL), spec.prior_length, mL))
        out[spec.hist_prefix] = rint2(np.where(np.isnan(mP), spec.prior_prefix, mP))
        out["n_prior_episodes"] = np.arange(len(pdf), dtype="int64") + int(n_rows)
        starts = pd.to_datetime(pdf[spec.start])
        out["late_episode"] = ((starts < pd.Timestamp(last)) if last is not None
                               else np.zeros(len(pdf), bool)).astype("int32")
        new_last = max(starts.max().date(), last) if last is not None else starts.max().date()
        state.update((int(s_len + np.nansum(L)), int(n_len + okL.sum()), int(s_pre + np.nansum(P)),
                      int(n_pre + okP.sum()), int(n_rows + len(pdf)), new_last))
        yield out

    return episodes.groupBy(spec.entity).applyInPandasWithState(
        update, out_schema, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def stream_daily_panel(episodes: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """History (stateful) -> encode -> expand (stateless) on a streaming frame."""
    return expand_days(encode_categories(stateful_history(episodes, spec), spec), spec)


def start_daily_sink(daily_stream: DataFrame, path: str, checkpoint: str, trigger_once: bool = True):
    """Append the streamed daily panel to Parquet; progress lives in ``checkpoint``
    (a shared folder), so a restarted query resumes where it stopped."""
    w = daily_stream.writeStream.format("parquet").option("path", path) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def episode_stream(spark, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Episode files arriving in a folder or its sub-folders (one micro-batch per
    ``files_per_batch`` new files, oldest first)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch) \
        .option("recursiveFileLookup", True).parquet(path) \
        .withColumn(DEFAULT.start, F.col(DEFAULT.start).cast("date"))
