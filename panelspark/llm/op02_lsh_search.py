"""Approximate nearest neighbours by multiprobe p-stable hashing, for the largest inner product.

*Measure.* With all vectors scaled by the largest norm and given one more coordinate that makes their length 1,
the largest inner product with a query is the smallest Euclidean distance to the query's direction.

*Index.* ``tables`` tables of ``hashes`` Gaussian projections, each cut into cells of ``width``; a
table's cells of a vector are its bucket. A query visits its own bucket and, in the order of their estimated
success, buckets whose cells are shifted by one: a set of shifts is the likelier the smaller the sum of the
squared distances to the cell borders it crosses.

*Search.* Points and probes meet by bucket. A task streams the points of a bucket past the bucket's
queries, keeps the best per query over all buckets it sees, and scores them exactly: inner product of the original
vectors in double precision. The candidates of all tables are merged and ranked. A query that found fewer than
``k`` is compared with all points.

*Fit.* Which rung of ``LADDER`` is used is decided on a sample of ``sample`` vectors (a documented bound): each rung's recall
against brute force and its scored pairs are measured there, and of those with ``recall`` the one with the least work on
the whole table is taken (:func:`work`: scored pairs, and vectors moved). A rung of one table scores no pair twice, so it
never scores more than an exact scan would. The last rung's cells are wider than any projection: it visits
every point, so some rung always has the recall. Neighbours are farther apart in a sample than in the whole table, so
the choice is on the safe side. Every row is indexed.

Scale: a bucket may hold any share of the rows; it is split into blocks of ``block`` points and of four times as many queries,
each pair of blocks a group of its own. Nothing is capped.

Edge cases: vectors that are null, zero, hold null or non-finite components, or have another dimension than
most take no part, nor do null ids; rows that repeat an id are one candidate, the best of them, and one query,
the smallest of their vectors; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage
from .op10_minhash import _mix as mix64


@dataclass(frozen=True)
class Params:
    hashes: int
    width: float
    tables: int
    probes: int


#: From few candidates to all of them; the last one's cells hold every projection of a vector of length 1.
LADDER = (Params(10, 1.0, 6, 20), Params(8, 1.5, 6, 40), Params(6, 2.0, 6, 40), Params(4, 1.5, 4, 30), Params(4, 2.0, 1, 80),
          Params(2, 2.0, 1, 9), Params(1, 2.0, 1, 3), Params(1, 64.0, 1, 3))
#: Moving a vector to a bucket costs about as much as scoring so many pairs.
MOVE = 200


def shift_sets(hashes: int, count: int) -> list[tuple[int, ...]]:
    """Sets of shift ranks (0: the nearest border) in the order of their expected sum of squares.

    Of two opposite shifts of one projection the ranks add up to ``2 * hashes - 1``; no set holds both."""
    k = hashes
    expected = [j * (j + 1) / (4 * (k + 1) * (k + 2)) for j in range(1, k + 1)]
    expected += [1 - (m := 2 * k + 1 - j) / (k + 1) + m * (m + 1) / (4 * (k + 1) * (k + 2)) for j in range(k + 1, 2 * k + 1)]
    sets: list[tuple[int, ...]] = [()]
    heap = [(expected[0], (0,))]
    while heap and len(sets) < count:
        s, own = heapq.heappop(heap)
        if all(2 * k - 1 - x not in own for x in own):
            sets.append(own)
        last = own[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (s - expected[last] + expected[last + 1], (*own[:-1], last + 1)))
            heapq.heappush(heap, (s + expected[last + 1], (*own, last + 1)))
    return sets


class Hasher:
    def __init__(self, params: Params, dim: int, norm: float, seed: int):
        rng = np.random.default_rng(seed)
        self.p, self.norm = params, norm
        self.a = rng.standard_normal((params.tables, dim + 1, params.hashes)) / params.width
        self.b = rng.uniform(0, 1, (params.tables, params.hashes))
        # a few more sets than are visited, ordered anew by each query's own distances
        self.sets = shift_sets(params.hashes, 2 * params.probes)
        self.member = np.zeros((len(self.sets), 2 * params.hashes))
        for i, s in enumerate(self.sets):
            self.member[i, list(s)] = 1

    def _key(self, table: int, cells: np.ndarray) -> np.ndarray:
        """Bucket number of each row of cells."""
        out = np.full(cells.shape[:-1], table + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(cells.shape[-1]):
                out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + cells[..., j].astype(np.int64).view(np.uint64))
        return out.view(np.int64)

    def points(self, x: np.ndarray) -> np.ndarray:
        """Buckets of vectors: one per table."""
        x = x / self.norm
        x = np.hstack((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))))
        return np.stack([self._key(t, np.floor(x @ self.a[t] + self.b[t])) for t in range(self.p.tables)], axis=1)

    def queries(self, x: np.ndarray) -> np.ndarray:
        """Buckets that queries visit: ``probes`` per table, the likeliest first."""
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        out, k = [], self.p.hashes
        for t in range(self.p.tables):
            y = x @ self.a[t][:-1] + self.b[t]
            cell = np.floor(y)
            border = np.hstack((y - cell, 1 - (y - cell)))  # to the cell below, to the cell above
            order = np.argsort(border, axis=1, kind="stable")
            success = np.take_along_axis(border, order, axis=1) ** 2 @ self.member.T
            best = np.argsort(success, axis=1, kind="stable")[:, :self.p.probes]
            shift = np.zeros((len(x), len(self.sets), k))
            rows = np.arange(len(x))
            for i, s in enumerate(self.sets):
                for r in s:
                    which = order[:, r]
                    shift[rows, i, which % k] += np.where(which < k, -1, 1)
            chosen = np.take_along_axis(shift, best[:, :, None], axis=1)
            out.append(self._key(t, cell[:, None, :] + chosen))
        return np.concatenate(out, axis=1)


def exact_scores(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Row by row inner products; unlike a matrix product they don't depend on the rows around."""
    return (q * p).sum(axis=1)


def best_of(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best different ``vec`` per query; ties to the smaller."""
    by = np.lexsort((vec, -score, query))
    query, vec, score = query[by], vec[by], score[by]
    pair = np.lexsort((-score, vec, query))
    again = np.zeros(len(query), bool)
    again[pair[1:]] = (query[pair[1:]] == query[pair[:-1]]) & (vec[pair[1:]] == vec[pair[:-1]])
    query, vec, score = query[~again], vec[~again], score[~again]
    start = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.concatenate((start, [len(query)]))))
    return query[rank < k], vec[rank < k], score[rank < k]


def scan(q_id: np.ndarray, q: np.ndarray, p_id: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of the points for each query, scored exactly, the query's own id left out."""
    found = []
    for i in range(0, len(q_id), 128):
        own = q[i:i + 128]
        s = own @ p.T
        s[q_id[i:i + 128, None] == p_id[None, :]] = -np.inf
        least = np.partition(s, -k, axis=1)[:, -k] if len(p_id) > k else np.full(len(own), -np.inf)
        r, c = np.nonzero((s >= (least - 1e-9 * (1 + abs(least)))[:, None]) & (s > -np.inf) if len(p_id) > k else s > -np.inf)
        found.append(best_of(q_id[i + r], p_id[c], exact_scores(own[r], p[c]), k))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _valid(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def work(params: Params, share: float, points: int, queries: int) -> float:
    """Scored pairs of a search whose queries score ``share`` of the points (over 1: some of them again), and its moved vectors."""
    return share * points * queries + MOVE * (params.tables * points + params.tables * params.probes * queries)


def measured(params: Params, ids: np.ndarray, x: np.ndarray, n: int, want: tuple, norm: float, seed: int) -> tuple[float, float]:
    """Recall of the first n rows as queries, and the share of the points a query scores."""
    h = Hasher(params, x.shape[1], norm, seed)
    points, probes, hits, scored = h.points(x), h.queries(x[:n]), 0, 0
    for i in range(n):
        met = np.isin(points, probes[i])
        scored += int(met.sum())
        hits += int(np.isin(want[1][want[0] == ids[i]], ids[met.any(axis=1)]).sum())
    return (hits / len(want[0]) if len(want[0]) else 1.0), scored / (n * len(ids))


def fit(vectors: DataFrame, norm: float, k: int, recall: float, sample: int, ladder: Sequence[Params], seed: int,
        points: int, queries: int) -> int:
    """The number of the rung of least work with this recall on a sample of at most ``sample`` vectors, a sixteenth of them queries;
    the one of most recall if none has it."""
    rows = vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id")).select("vec_id", "vec").limit(sample).toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["vec"].to_numpy()).astype(np.float64)
    n = max(1, len(ids) // 16)
    want = scan(ids[:n], x[:n], ids, x, k)
    seen = [(p, *measured(p, ids, x, n, want, norm, seed)) for p in ladder]
    least = min(recall, max(r for _, r, _ in seen))
    return min((work(p, share, points, queries), i) for i, (p, r, share) in enumerate(seen) if r >= least)[1]


def search(dealt: DataFrame, k: int, id_type: str) -> DataFrame:
    """``dealt``: key, p, q (block numbers), side (0 query, 1 point), vec_id, vec. Partial results query_id, vec_id, score."""
    dealt = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "side", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found, size = None, [], [], 0

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            key = np.stack([c.to_numpy() for c in batch.columns[:3]])
            side, ids, x = batch.column(3).to_numpy(), batch.column(4).to_numpy(), _matrix(batch.column(5))
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0) | (side[1:] != side[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if tuple(key[:, i]) != now:
                    now, held = tuple(key[:, i]), []
                if side[i] == 0:
                    held.append((ids[i:j], x[i:j]))
                elif held:  # points after all queries of their group
                    if len(held) > 1:
                        held = [tuple(np.concatenate(a) for a in zip(*held, strict=True))]
                    for a in range(i, j, 4096):
                        found.append(scan(*held[0], ids[a:min(a + 4096, j)], x[a:min(a + 4096, j)], k))
                        size += len(found[-1][0])
                    if size > 500_000:
                        found = [best_of(*(np.concatenate(c) for c in zip(*found, strict=True)), k)]
                        size = len(found[0][0])
                        if size > 250_000:
                            yield out(found[0])
                            found, size = [], 0
        if found:
            yield out(best_of(*(np.concatenate(c) for c in zip(*found, strict=True)), k))

    return dealt.mapInArrow(run, f"query_id {id_type}, vec_id {id_type}, score double")


def blocked(points: DataFrame, probes: DataFrame, block: int) -> DataFrame:
    """Points and queries (key, vec_id, vec) of each key in pairs of blocks, of ``block`` points and four times as many queries;
    keys without one of the two are left out."""
    count = lambda df, n: df.groupBy(F.col("key").alias(f"{n}_key")).agg(F.count("*").alias(n))
    sizes = count(points, "np").join(count(probes, "nq"), F.col("np_key") == F.col("nq_key")).select(
        F.col("np_key").alias("s_key"), F.ceil(F.col("np") / block).alias("bp"), F.ceil(F.col("nq") / (4 * block)).alias("bq"))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    cols = ["key", "p", "q", "side", "vec_id", "vec"]
    right = points.join(sizes, F.col("key") == F.col("s_key")).withColumn("p", own("bp")).withColumn("q", every("bq"))
    left = probes.join(sizes, F.col("key") == F.col("s_key")).withColumn("q", own("bq")).withColumn("p", every("bp"))
    return left.withColumn("side", F.lit(0)).select(cols).unionByName(right.withColumn("side", F.lit(1)).select(cols))


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = 20,
            recall: float = 0.93, sample: int = 4096, ladder: Sequence[Params] = LADDER, block: int = 4096, seed: int = 3) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row for which ``queries`` holds."""
    spark = vectors.sparkSession
    all_rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").alias("vec"), queries.alias("is_query"))
    all_rows = all_rows.filter(F.col("vec_id").isNotNull() & _valid(F.col("vec")))
    id_type = all_rows.schema["vec_id"].dataType.simpleString()
    square = F.aggregate("vec", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x)
    dims = (all_rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.sqrt(F.max(square)).alias("norm"),
                                                           F.count_if("is_query").alias("asked"))
            .orderBy(F.desc("n"), "d").first())
    if dims is None:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    dim, norm = dims["d"], dims["norm"]
    all_rows = all_rows.filter(F.size("vec") == dim)
    params = ladder[fit(all_rows, norm, k, recall, sample, ladder, seed, dims["n"], dims["asked"])]

    def keyed(df: DataFrame, probes: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = Hasher(params, dim, norm, seed)
            for batch in batches:
                for i in range(0, batch.num_rows, 2048):
                    part = batch.slice(i, 2048)
                    x = _matrix(part.column(1))
                    keys = hasher.queries(x) if probes else hasher.points(x)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["vec_id", "vec", "keys"])

        kind = df.schema["vec"].dataType.simpleString()
        out = df.mapInArrow(run, f"vec_id {id_type}, vec {kind}, keys array<bigint>")
        return out.select("vec_id", "vec", F.explode_outer(F.array_distinct("keys") if probes else F.col("keys")).alias("key"))

    asked = stage(all_rows.filter("is_query").groupBy("vec_id").agg(F.min("vec").alias("vec")), "op2-queries")
    points = stage(keyed(all_rows.select("vec_id", "vec"), False), "op2-points")
    probes = stage(keyed(asked, True), "op2-probes")
    found = stage(search(blocked(points, probes, block), k, id_type), "op2-found")
    ranked = stage(_top(found, k), "op2-ranked")
    # a query with too few candidates meets all points: its block numbers stand for the bucket
    short = asked.join(ranked.filter(F.col("rank") == k).select(F.col("query_id").alias("e_id")), F.col("vec_id") == F.col("e_id"), "left_anti")
    if short.select("vec_id").isEmpty():
        return ranked
    n_blocks = dims["n"] // block + 1
    every = short.select("vec_id", "vec", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("key"))
    plain = all_rows.select("vec_id", "vec", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("key"))
    rest = search(blocked(plain, every, block), k, id_type)
    return _top(ranked.drop("rank").unionByName(rest), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
