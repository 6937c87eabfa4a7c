"""Ranked lexical search with bag deduplication.

Terms are runs of letters and digits (fixed pattern below), A-Z lower-cased. A document scores an item by
``w * ((1e9 * tf) div (1000 * tf + 8 * m))`` summed over the item's distinct terms, in integers: w is the term's weight by
document frequency, m the document's length against the mean (BM25 with k1 0.8 and b 0.9).

* Restriction: one pass over the texts keeps, per document, its number of terms and the counts of the terms that any item
  has (the item vocabulary), as one byte string in ascending term order.
* Classes: an item's score depends on these counts and on m alone. Documents are grouped by a 64-bit hash of
  both; the counts and m themselves are grouping keys behind the hash, which verifies that a class is one.
  A class keeps its ``k`` smallest ids: of equal scores, ascending ids come first, so no item can need more.
* Scoring: each class is scored once against all items of a block, by adding up the postings of the item's terms; a
  task keeps the ``k`` best classes of each item. Of the best classes of all tasks the members are listed in ascending order
  and the first ``k`` taken. (A class beyond the first k has k documents before it, so nothing is lost.)

Scale: the texts are read once per block of items; a block holds at most ``max_terms`` item terms (or one item), whatever
the number of items, and is all that is sent to the tasks. Only the byte strings are shuffled, once, by class; a
large group of copies arrives as at most k rows a task (group limit below the exchange). The best classes are at most k rows an item
and task. Counts over all documents (N, L, df) are ordinary sums with partial aggregation.

Edge cases: a null or empty text has no terms, so it counts in nothing and is never found; an item without terms has no rows;
every row is a document and an item of its own, so repeated rows are ranked each; a null id ranks behind all others
of its score; equal scores by ascending id; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_blocks import split_words, text_blocks
from .common import stage, text_of

#: Fixed value: what stands between terms.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values of the score.
SCALE, TF_SCALE, M_SCALE, LENGTH_SHARE, WEIGHT_SCALE = 1_000_000_000, 1000, 8, 90, 1000
#: Sums of whole numbers up to here are exact in doubles.
DOUBLES_WHOLE_BELOW = 2 ** 53


def item_terms(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN, -1), "")))


def item_blocks(items: DataFrame, max_terms: int) -> Iterator[list[tuple[int, list[str]]]]:
    """(number, terms) of the items in blocks of at most ``max_terms`` terms, one block in memory at a time."""
    block: list[tuple[int, list[str]]] = []
    held = 0
    for row in items.select("_no", "_terms").toLocalIterator():
        if block and held + len(row._terms) > max_terms:
            yield block
            block, held = [], 0
        block.append((row._no, row._terms))
        held += len(row._terms)
    if block:
        yield block


def term_vectors(docs: DataFrame, vocabulary: list[str], block_bytes: int = 4_000_000) -> DataFrame:
    """(_id, _text) -> _id, _n (terms of the text), _vec: little-endian 32-bit pairs (number, count) of the terms in
    the sorted vocabulary, ascending."""
    width = max(len(vocabulary), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        for block in text_blocks(batches, "_text", block_bytes):
            flat, sizes = split_words(pc.ascii_lower(block.column("_text")), BETWEEN)
            number = pc.fill_null(pc.index_in(flat.cast(pa.string()), value_set=known), -1).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            key, count = np.unique((doc * width + number)[number >= 0], return_counts=True)
            pairs = np.column_stack((key % width, count)).astype("<i4")
            upto = np.concatenate(([0], np.cumsum(np.bincount(key // width, minlength=len(sizes))))) * 8
            vec = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(upto.astype(np.int32).tobytes()),
                                                                  pa.py_buffer(pairs.tobytes())])
            yield pa.RecordBatch.from_arrays([block.column("_id"), pa.array(sizes), vec], names=["_id", "_n", "_vec"])

    return docs.mapInArrow(run, f"_id {docs.schema['_id'].dataType.simpleString()}, _n bigint, _vec binary")


def document_frequency(vectors: DataFrame, terms: int) -> np.ndarray:
    """For each term of the vocabulary the number of documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4")[::2], minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["t", "df"])

    out = np.zeros(terms, np.int64)
    for r in vectors.select("_vec").mapInArrow(run, "t bigint, df bigint").groupBy("t").agg(F.sum("df").alias("df")).collect():
        out[r.t] = r.df
    return out


def bag_classes(vectors: DataFrame, m: Column, k: int) -> DataFrame:
    """_m, _vec, _ids: one row per class of equal vectors and m, with its k smallest ids (nulls last)."""
    kind = vectors.schema["_id"].dataType.simpleString()
    df = vectors.filter(F.length("_vec") > 0).select("_id", m.alias("_m"), "_vec")
    df = df.withColumn("_hash", F.xxhash64("_vec", "_m"))
    key = ["_hash", "_m", "_vec"]
    first = Window.partitionBy(*key).orderBy(F.col("_id").asc_nulls_last())
    df = df.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k)
    # structs, as a plain list would leave out null ids
    own = F.transform(F.array_sort(F.collect_list(F.struct("_r", "_id"))), lambda x: x["_id"])
    return df.groupBy(*key).agg(own.cast(f"array<{kind}>").alias("_ids")).drop("_hash")


def best_classes(classes: DataFrame, block: list[tuple[int, list[str]]], vocabulary: list[str], weight: np.ndarray,
                 k: int) -> DataFrame:
    """_no, score, _ids: of each task the k best classes of each item, with scores above 0."""
    place = {t: i for i, t in enumerate(vocabulary)}
    asked = [(no, np.array([i for t in terms if weight[i := place[t]]], np.int64)) for no, terms in block]
    exact = max((int(weight[t].sum()) for _, t in asked), default=0) * (SCALE // TF_SCALE) < DOUBLES_WHOLE_BELOW
    kind = classes.schema["_ids"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {no: [] for no, _ in asked}  # (-score, id is null, id, ids), ascending
        for batch in batches:
            # rows in the order of their first ids, so that a row's number breaks ties
            firsts = pc.list_element(batch.column("_ids"), 0)
            batch = batch.take(pc.sort_indices(firsts, null_placement="at_end"))
            vecs, m = batch.column("_vec").to_pylist(), batch.column("_m").to_numpy()
            pairs = np.frombuffer(b"".join(vecs), "<i4").reshape(-1, 2).astype(np.int64)
            row = np.repeat(np.arange(len(vecs)), [len(v) // 8 for v in vecs])
            by = np.argsort(pairs[:, 0], kind="stable")
            row, term, tf = row[by], pairs[by, 0], pairs[by, 1]
            part = (SCALE * tf) // (TF_SCALE * tf + M_SCALE * m[row]) * weight[term]
            upto = np.searchsorted(term, np.arange(len(vocabulary) + 1))
            for no, terms in asked:
                spans = [slice(upto[t], upto[t + 1]) for t in terms.tolist() if upto[t] < upto[t + 1]]
                if not spans:
                    continue
                rows, parts = np.concatenate([row[s] for s in spans]), np.concatenate([part[s] for s in spans])
                if exact:
                    score = np.bincount(rows, weights=parts, minlength=len(vecs)).astype(np.int64)
                else:
                    score = np.zeros(len(vecs), np.int64)
                    np.add.at(score, rows, parts)
                mine = best[no]
                floor = -mine[-1][0] if len(mine) == k else 1
                at = np.flatnonzero(score >= max(floor, 1))
                if len(at) > k:
                    at = at[np.argsort(-score[at], kind="stable")[:k]]
                for i in at.tolist():
                    ids = batch.column("_ids")[i].as_py()
                    mine.append((-int(score[i]), ids[0] is None, ids[0], ids))
                mine.sort(key=lambda x: x[:2] if x[1] else x[:3])
                del mine[k:]
        rows = [(no, -x[0], x[3]) for no, xs in best.items() for x in xs]
        if rows:
            numbers, scores, ids = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(scores, pa.int64()),
                                              pa.array(ids, batch.schema.field("_ids").type)], names=["_no", "score", "_ids"])

    return classes.mapInArrow(run, f"_no bigint, score bigint, _ids {kind}")


def _search_block(docs: DataFrame, block: list[tuple[int, list[str]]], k: int) -> DataFrame:
    """_no, rank, _id, score for the items of one block."""
    vocabulary = sorted({t for _, terms in block for t in terms})
    vectors = stage(term_vectors(docs, vocabulary), "op12-vectors")
    total = vectors.agg(F.count_if(F.col("_n") > 0).alias("N"), F.coalesce(F.sum("_n"), F.lit(0)).alias("L")).first()
    df = document_frequency(vectors, len(vocabulary))
    weight = np.array([math.floor(WEIGHT_SCALE * math.log((2 * total.N + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    m = F.expr(f"{100 - LENGTH_SHARE}L + ({LENGTH_SHARE}L * _n * {total.N}L) div {max(total.L, 1)}L")
    found = stage(best_classes(bag_classes(vectors, m, k), block, vocabulary, weight, k), "op12-best")
    first = F.col("_ids")[0]
    of_item = Window.partitionBy("_no")
    found = found.withColumn("_r", F.row_number().over(of_item.orderBy(F.desc("score"), first.asc_nulls_last()))).filter(F.col("_r") <= k)
    each = found.select("_no", "score", F.explode("_ids").alias("_id"))
    each = each.withColumn("rank", F.row_number().over(of_item.orderBy(F.desc("score"), F.col("_id").asc_nulls_last())))
    return each.filter(F.col("rank") <= k).select("_no", "rank", "_id", "score")


def lexical_search(items: DataFrame, docs: DataFrame, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id",
                   text_col: str = "text", *, k: int = 10, max_terms: int = 500_000) -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), the document's id, score."""
    asked = items.select(F.col(f"`{item_id}`").alias("_item"), item_terms(text_of(item_text)).alias("_terms"))
    asked = stage(asked.withColumn("_no", F.monotonically_increasing_id()), "op12-items")
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("_text"))
    parts = [_search_block(texts, block, k) for block in item_blocks(asked.filter(F.size("_terms") > 0), max_terms)]
    if not parts:
        none = texts.limit(0).select(F.lit(0).cast("long").alias("_no"), F.lit(0).alias("rank"), "_id", F.lit(0).cast("long").alias("score"))
        parts = [none]
    out = asked.select("_no", "_item").join(reduce(DataFrame.unionAll, parts), "_no")
    return out.select(F.col("_item").alias(item_id), "rank", F.col("_id").alias(id_col), "score")
