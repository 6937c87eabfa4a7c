"""SRC1-SRC6 readers and SNK1-SNK8 writers.

Stage outputs are Parquet (types survive between stages, partition columns
prune): the daily panel clustered by entity, split panels and windows
partitioned by ``split`` / ``seq_length``; metadata is one-row JSON.
Writing a stage is also how long plans cut lineage on a cluster: the files
live in the shared output folder, not on a machine-local disk.
"""

from __future__ import annotations

import json
import os

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..operators.clean import normalize_column_names, parse_date, parse_dates, sort_for_sink
from ..spec import DEFAULT, REQUIRED_COLUMNS, PanelSpec
from .arrays import can_write, write_arrays
from .store import read_document, write_document

RAW_TYPES = {
    "user_id": "bigint", "age": "int", "bmi": "double", "stress_level": "int",
    "exercise_frequency": "string", "sleep_hours": "double", "diet": "string",
    "cycle_length": "int", "period_length": "int", "symptoms": "string",
}


# --- sources ------------------------------------------------------------------

def read_episodes_csv(spark: SparkSession, path: str, spec: PanelSpec = DEFAULT,
                      types: dict | None = None) -> DataFrame:
    """SRC1 (+PRJ1, PRJ2): header CSV read as strings (no schema inference pass),
    names normalised, values cast with ``try_cast`` (bad value -> null), dates
    parsed leniently. A missing path raises from the reader. :func:`typed_episodes` also says what could not be read."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    df = normalize_column_names(raw, REQUIRED_COLUMNS)
    types = {**RAW_TYPES, **(types or {})}
    df = df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})
    return parse_dates(df, spec)


#: Cell texts that mean "no value" and are no error.
MISSING_TEXTS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None")

RAW_RECORD, BAD_CELLS, SOURCE_FILE = "_raw_record", "_bad_cells", "_source_file"


def _cell(raw: str, name: str, kind: str) -> tuple[Column, Column]:
    """The typed value of a text cell, and why it can't be read (null if it can, or has no value)."""
    text = F.trim(F.col(f"`{raw}`"))
    given = ~F.coalesce(text.isin(*MISSING_TEXTS), F.lit(True))
    value = parse_date(text) if kind == "date" else text.try_cast(kind)
    bad = F.when(value.isNull(), F.lit(f"not a {kind}"))
    if kind in ("double", "float"):
        bad = bad.when(F.abs(value) == float("inf"), F.lit("not finite"))
    why = F.when(given, bad)
    return F.when(given & why.isNull(), value).alias(name), \
        F.when(why.isNotNull(), F.struct(F.lit(name).alias("column_name"), F.col(f"`{raw}`").alias("raw_value"), why.alias("reason")))


def typed_episodes(spark: SparkSession, path: str, spec: PanelSpec = DEFAULT, types: dict | None = None) -> DataFrame:
    """SRC1 + PRJ1 + PRJ2 + PRJ3 with a reject channel: every record of a header CSV with typed cells, its text, its
    file and the list of what can't be read: (column, text, reason) per cell, or one entry for a record with too few or too
    many cells. One pass; split it with :func:`accepted` and :func:`rejects`.

    A cell that is empty or one of ``MISSING_TEXTS`` is null and no error. Files whose header differs from the first one's
    are an error of the read, as is a missing path."""
    header = spark.read.option("header", True).option("inferSchema", False).csv(path)
    names = normalize_column_names(header, REQUIRED_COLUMNS).columns
    broken = "_broken_record"
    schema = reduce(lambda s, c: s.add(c, StringType()), [*header.columns, broken], StructType())
    raw = (spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("columnPruning", False)
           .option("escape", '"')  # a quote in a quoted cell is doubled
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", broken).csv(path))
    kinds = {**RAW_TYPES, **(types or {}), spec.start: "date", spec.next_start: "date"}
    cells = {n: _cell(c, n, kinds[n]) for c, n in zip(header.columns, names, strict=True) if n in kinds}
    whole = F.array(F.struct(F.lit(None).cast("string").alias("column_name"), F.col(broken).alias("raw_value"),
                             F.lit("wrong number of cells").alias("reason")))
    bad = F.when(F.col(broken).isNotNull(), whole).otherwise(F.array_compact(F.array(*[b for _, b in cells.values()])))
    return raw.select(
        *[cells[n][0] if n in cells else F.col(f"`{c}`").alias(n) for c, n in zip(header.columns, names, strict=True)],
        F.coalesce(F.col(broken), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in header.columns]))).alias(RAW_RECORD),
        bad.alias(BAD_CELLS), F.col("_metadata.file_path").alias(SOURCE_FILE))


def accepted(typed: DataFrame) -> DataFrame:
    """The records of :func:`typed_episodes` that could be read, without its helper columns."""
    return typed.filter(F.size(BAD_CELLS) == 0).drop(RAW_RECORD, BAD_CELLS, SOURCE_FILE)


def rejects(typed: DataFrame) -> DataFrame:
    """One row per unreadable cell or record: source_file, raw_record, column_name, raw_value, reason."""
    return typed.filter(F.size(BAD_CELLS) > 0).select(
        F.col(SOURCE_FILE).alias("source_file"), F.col(RAW_RECORD).alias("raw_record"), F.explode(BAD_CELLS).alias("c")) \
        .select("source_file", "raw_record", "c.*")


def reject_counts(typed: DataFrame) -> DataFrame:
    """Unreadable cells by column and reason."""
    return rejects(typed).groupBy("column_name", "reason").agg(F.count(F.lit(1)).alias("n_cells"))


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: the daily panel (typed dates come back as DateType)."""
    return spark.read.parquet(path)


def read_splits(spark: SparkSession, path: str, splits=None) -> DataFrame:
    """SRC3: split panels; a filter on the ``split`` partition column prunes files."""
    df = spark.read.parquet(path)
    return df if splits is None else df.filter(F.col("split").isin(list(splits)))


def read_contract(spark: SparkSession, path: str) -> dict:
    """SRC4: the feature contract (one JSON document) as a dict."""
    return read_document(spark, path)


def read_windows(spark: SparkSession, path: str, seq_length: int, splits=None, schema=None) -> DataFrame:
    """SRC5: windows of one length (partition pruning on ``seq_length``); a ``schema`` lets the store be empty."""
    df = (spark.read if schema is None else spark.read.schema(schema)).parquet(path).filter(F.col("seq_length") == seq_length)
    return df if splits is None else df.filter(F.col("split").isin(list(splits)))


def read_reports(spark: SparkSession, pattern: str) -> DataFrame:
    """SRC6: saved experiment reports; the experiment name comes from the file name."""
    df = spark.read.json(pattern)
    if "experiment" in df.columns:  # write_report's partition column: one document per line
        return df
    df = spark.read.option("multiLine", True).json(pattern)  # one document per file
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(_metrics)?\.json$", 1)
    return df.withColumn("experiment", name)


def read_histories(spark: SparkSession, pattern: str) -> DataFrame:
    """SRC6: saved training histories (one JSON object of equal-length arrays per file)."""
    df = spark.read.json(pattern)
    if "experiment" in df.columns:  # write_report's partition column: one document per line
        return df
    df = spark.read.option("multiLine", True).json(pattern)  # one document per file
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(_history)?\.json$", 1)
    return df.withColumn("experiment", name)


# --- sinks --------------------------------------------------------------------

def write_daily(daily: DataFrame, path: str, spec: PanelSpec = DEFAULT, mode: str = "overwrite",
                range_cluster: bool = False) -> None:
    """SNK1: fixed column order; a missing column is an error (the reference drops it
    silently).  By default rows are sorted by (entity, start, day) inside the
    partitions the panel already has (no shuffle of the ~37x larger daily rows);
    ``range_cluster`` range-partitions first (one full shuffle) for globally
    ordered files.  ``plans.pipelines.daily_for_sink`` gets ordered files for the
    price of an episode-level shuffle instead."""
    missing = [c for c in spec.daily_columns if c not in daily.columns]
    if missing:
        raise ValueError(f"daily panel lacks columns: {missing}")
    out = daily.select(*spec.daily_columns)
    out = (sort_for_sink(out, spec, (spec.day,)) if range_cluster
           else out.sortWithinPartitions(spec.entity, spec.start, spec.day))
    out.write.mode(mode).parquet(path)


def write_splits(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK2: one folder per split."""
    panel.write.mode(mode).partitionBy("split").parquet(path)


def write_bucketed(panel: DataFrame, table: str, path: str, buckets: int, spec: PanelSpec = DEFAULT, keys=None,
                   order=None) -> DataFrame:
    """SNK1 / SNK2 as a bucketed table: rows of an episode in one bucket, buckets sorted, one file each. Grouping
    by episode (GEN2, DQ6) then needs no exchange. Choose ``buckets`` for files of a few hundred MB; a large entity is
    spread by its starts. The table name is known to the session's catalog; :func:`open_bucketed` makes the files known
    to another."""
    keys, order = list(keys or spec.episode_keys), list(order or [*spec.episode_keys, spec.day])
    out = panel.repartition(buckets, *keys)
    out.write.bucketBy(buckets, *keys).sortBy(*order).option("path", path).saveAsTable(table)
    return panel.sparkSession.table(table)


def open_bucketed(spark: SparkSession, table: str, path: str, buckets: int, spec: PanelSpec = DEFAULT, keys=None,
                  order=None) -> DataFrame:
    """A folder that :func:`write_bucketed` wrote, as a table of this session, with the same buckets."""
    keys, order = list(keys or spec.episode_keys), list(order or [*spec.episode_keys, spec.day])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    names = lambda cs: ", ".join(f"`{c}`" for c in cs)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({names(keys)}) SORTED BY ({names(order)}) "
              f"INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def write_membership(membership: DataFrame, path: str, ratios, seed: int, mode: str = "overwrite",
                     spec: PanelSpec = DEFAULT) -> None:
    """SNK3: entity -> split, with the split parameters as columns."""
    membership.select(spec.entity, "split", F.lit(float(ratios[0])).alias("train_ratio"),
                      F.lit(float(ratios[1])).alias("val_ratio"), F.lit(float(ratios[2])).alias("test_ratio"),
                      F.lit(int(seed)).alias("random_state")).write.mode(mode).parquet(path)


def write_scaler(params: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK4: the fitted min/max parameters (one row)."""
    params.coalesce(1).write.mode(mode).parquet(path)


def write_contract(spark: SparkSession, path: str, spec: PanelSpec = DEFAULT, stage: str = "encoded",
                   extra: dict | None = None) -> None:
    """SNK5: feature contract + preprocessing metadata as one JSON row; ``stage``
    replaces the reference's ``not_*_yet`` flags."""
    doc = {
        "stage": stage,
        "input_features": spec.input_features,
        "scaled_columns": list(spec.scale_columns),
        "indicator_columns": spec.indicator_columns,
        "targets": {"regression": spec.countdown, "classification": spec.label},
        "excluded_from_input": sorted(spec.leakage),
        "phase_mapping": {n: i for i, n in enumerate(spec.phase_names)},
        "cold_start_priors": {spec.hist_length: spec.prior_length, spec.hist_prefix: spec.prior_prefix},
        **(extra or {}),
    }
    spec.check_no_leakage()
    write_document(spark, path, doc)


def update_contract(spark: SparkSession, path: str, sections: dict) -> dict:
    """SNK5: add or replace sections (split, scaler, stage) of a stored contract, keeping the others. The contract
    before stays in place until the new one is whole."""
    doc = {**read_contract(spark, path), **sections}
    write_document(spark, path, doc)
    return doc


def write_windows(w: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK6: window arrays partitioned by length and split, encoded by Arrow (:mod:`panelspark.sources.arrays`). Where Arrow
    lacks a type or the file system Spark writes: a task then keeps a file open per folder (they are few) rather than
    sort its windows by folder first; with more folders than that Spark sorts."""
    by = ["seq_length", "split"]
    if can_write(w, path, by):
        return write_arrays(w, path, by, mode)
    conf, name = w.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name, "0")
    conf.set(name, "16")
    try:
        w.write.mode(mode).partitionBy(*by).parquet(path)
    finally:
        conf.set(name, before)


def window_metadata(w: DataFrame, n_features: int | None = None, spec: PanelSpec = DEFAULT) -> DataFrame:
    """SNK7: shapes per (split, length): n_windows x L x F (F measured on ``X`` unless given) and the targets."""
    width = F.max(F.size(F.col("X")[0])) if n_features is None else F.lit(int(n_features))
    return w.groupBy("split", "seq_length").agg(F.count(F.lit(1)).alias("n_windows"), width.alias("n_features")) \
        .withColumn("targets", F.array(F.lit(spec.label), F.lit(spec.countdown)))


def write_window_metadata(meta: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK7 as JSON lines, one per (split, length)."""
    meta.coalesce(1).write.mode(mode).json(path)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK8: metrics / history documents keyed by experiment."""
    report.write.mode(mode).partitionBy("experiment").json(path)


def write_json_doc(path: str, doc: dict) -> None:
    """Driver-side helper for the small metadata documents of tests and tools."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2)
