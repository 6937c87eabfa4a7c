"""SRT1 as data: is a Parquet folder in key order, file by file and over its files?

The position of a row comes from the reader (``_metadata.file_path`` and ``_metadata.row_index``). A task compares rows with
their predecessor as it reads them and gives one row per stretch of consecutive rows of a file; only the first and last
key of each stretch meet per file, and only the smallest and largest key of each file meet over the folder. Rows are
neither shuffled nor sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def _ranks(column: pa.Array) -> np.ndarray:
    """Dense ranks as Spark sorts: nulls first, NaN last."""
    if pa.types.is_boolean(column.type):
        column = pc.cast(column, pa.int8())
    nan = None
    if pa.types.is_floating(column.type):
        nan = pc.fill_null(pc.is_nan(column), False)
        column = pc.if_else(nan, pa.scalar(None, column.type), column)
    # ranks of the values from 1; nulls get 0
    ranks = pc.rank(column, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
    ranks[~column.is_valid().to_numpy(zero_copy_only=False)] = 0
    if nan is not None:
        ranks[nan.to_numpy(zero_copy_only=False)] = len(ranks) + 1
    return ranks


def _stretches(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Per stretch of at most ``block`` consecutive rows of one file: file, first place, rows, descents, and its first,
    last, smallest and largest key. The last two columns of a batch are file and place, those before them the key."""
    for batch in (b.slice(at, block) for b in batches for at in range(0, b.num_rows, block)):
        keys, file, i = batch.columns[:-2], batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_numpy()
        code = np.zeros(batch.num_rows, np.int64)
        for k in keys:  # a number per row in the order of the keys
            ranks = _ranks(k)
            code = np.unique(code * (ranks.max() + 1) + ranks, return_inverse=True)[1]
        moved = pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False) | (np.diff(i) != 1)
        starts = np.concatenate(([0], np.flatnonzero(moved) + 1))
        ends = np.concatenate((starts[1:], [batch.num_rows]))
        down = np.concatenate(([False], code[1:] < code[:-1]))
        down[starts] = False
        low = [s + int(code[s:e].argmin()) for s, e in zip(starts, ends, strict=True)]
        high = [s + int(code[s:e].argmax()) for s, e in zip(starts, ends, strict=True)]
        names = batch.schema.names[:-2]
        at = [pa.StructArray.from_arrays([k.take(pa.array(rows)) for k in keys], names=names) for rows in (starts, ends - 1, low, high)]
        yield pa.RecordBatch.from_arrays(
            [file.take(pa.array(starts)), pa.array(i[starts]), pa.array(ends - starts), pa.array(np.add.reduceat(down.astype(np.int64), starts)), *at],
            names=["file", "b", "n", "n_down", "head", "tail", "low", "high"])


def by_hash(rows: DataFrame, keys, partitions: int, block: int = 1 << 18) -> DataFrame:
    """The rows in partitions by a hash of the keys. What is shuffled are packs: the rows of one task and partition, column by
    column and compressed, up to ``block`` rows of the task at a time. Rows that come in some order stay in it inside a
    pack, so it is a small part of the rows one by one."""
    schema = to_arrow_schema(rows.schema)
    place = F.pmod(F.xxhash64(*keys), F.lit(partitions)).cast("int")

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= block:
                yield _packed(held, schema)
                held, n = [], 0
        if n:
            yield _packed(held, schema)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, pack in zip(batch.column("size").to_pylist(), batch.column("pack"), strict=True):
                yield from pa.ipc.open_stream(pa.decompress(pack.as_buffer(), size, "zstd"))

    packed = rows.select("*", place.alias("__place")).mapInArrow(packs, "place int, size bigint, pack binary")
    packed = packed.repartitionById(partitions, F.col("place"))
    return packed.mapInArrow(unpack, rows.schema)


def _packed(batches: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
    """A row per place: place, bytes, compressed stream of its rows."""
    table = pa.Table.from_batches(batches)
    place = table.column(table.num_columns - 1).to_numpy()
    order = np.argsort(place, kind="stable")
    places, begins = np.unique(place[order], return_index=True)
    table = table.select(range(table.num_columns - 1)).cast(schema).take(pa.array(order)).combine_chunks()
    sizes, out = [], []
    for a, b in zip(begins, [*begins[1:], len(order)], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as stream:
            stream.write_table(table.slice(a, b - a))
        raw = sink.getvalue()
        sizes.append(raw.size)
        out.append(pa.compress(raw, "zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["place", "size", "pack"])


def file_order(spark: SparkSession, path: str, keys, block: int = 1 << 18) -> DataFrame:
    """One row per file: file, n_rows, n_descents (rows whose key is smaller than that of the row before), first_key and
    last_key (smallest and largest). Equal keys are in order; null keys come first, as Spark sorts them."""
    rows = spark.read.parquet(path).select(*keys, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__i"))
    key = rows.select(F.struct(*keys).alias("k")).schema["k"].dataType.simpleString()
    stretches = rows.mapInArrow(lambda batches: _stretches(batches, block), "file string, b bigint, n bigint, n_down bigint, "
                                            f"head {key}, tail {key}, low {key}, high {key}")
    edge = F.lag("tail").over(Window.partitionBy("file").orderBy("b")) > F.col("head")
    return stretches.withColumn("edge", edge).groupBy("file").agg(
        F.sum("n").alias("n_rows"), (F.sum("n_down") + F.count_if("edge")).alias("n_descents"),
        F.min("low").alias("first_key"), F.max("high").alias("last_key"))


def order_report(spark: SparkSession, path: str, keys, block: int = 1 << 18) -> DataFrame:
    """One row for a folder: n_rows, n_files, n_descents inside files, and n_overlaps, the files whose keys begin before
    those of the files before them end (a key that goes on in the next file is none)."""
    files = file_order(spark, path, keys, block)
    # a row per file: files are what a folder listing already holds on the driver
    so_far = Window.orderBy("first_key", "last_key").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("overlaps", F.max("last_key").over(so_far) > F.col("first_key"))
    return files.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_files"),
                     F.coalesce(F.sum("n_descents"), F.lit(0)).alias("n_descents"), F.count_if("overlaps").alias("n_overlaps"))
