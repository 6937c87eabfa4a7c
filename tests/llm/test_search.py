"""Nearest neighbours: choice of the rung, repeated ids, clashing columns; the shared folder of a session without one."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import common
from panelspark.llm import op02_lsh_search as op2


def _vectors(clustered: bool, n: int, dim: int) -> np.ndarray:
    rng = np.random.default_rng(4)
    if not clustered:
        return rng.standard_normal((n, dim))
    centres = rng.standard_normal((n // 25, dim))
    return np.repeat(centres, 25, axis=0)[:n] + 0.02 * rng.standard_normal((n, dim))


def _rung(x: np.ndarray, k: int = 20):
    ids, n = np.arange(len(x)), 128
    norm = np.sqrt((x * x).sum(axis=1).max())
    want = op2.scan(ids[:n], x[:n], ids, x, k)
    return [op2.measured(p, ids, x, n, want, norm, 3) for p in op2.LADDER]


def test_last_rung_is_exact_and_one_table_never_scores_twice():
    for clustered in (True, False):
        seen = _rung(_vectors(clustered, 1500, 32))
        assert seen[-1] == (1.0, 1.0)
        assert all(share <= 1 for p, (_, share) in zip(op2.LADDER, seen, strict=True) if p.tables == 1)


def test_fit_takes_few_candidates_where_vectors_cluster_and_at_most_a_scan_elsewhere(spark):
    for clustered in (True, False):
        x = _vectors(clustered, 3000, 48)
        # one length, so that the nearest by inner product are those of the own cluster
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<double>")
        # ten neighbours: a cluster has about 17 of its 25 vectors in the sample
        at = op2.fit(df, 1.0, 10, 0.93, 2048, op2.LADDER, 3, 10**7, 5 * 10**5)
        recall, share = _rung(x, 10)[at]
        assert recall >= 0.9
        assert share < 0.2 if clustered else share <= 1 and op2.LADDER[at].tables == 1


def test_repeated_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((120, 8)).round(2)
    ids = [i % 100 for i in range(120)]  # ids 0 to 19 twice, with other vectors
    rows = [(i, v.tolist(), "a", 1.0, 7, [0]) for i, v in zip(ids, x, strict=True)] + [(0, x[0].tolist(), "b", 2.0, 8, [1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string, score double, rank int, vec array<int>")
    got = {}
    for r in op2.nearest(df, F.col("vec_id") % 20 == 0, k=5, block=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [0, 20, 40, 60, 80]
    for q, found in got.items():
        own = np.array(min(v.tolist() for i, v in zip(ids, x, strict=True) if i == q))
        best = {}
        for i, v in zip(ids, x, strict=True):
            if i != q:
                best[i] = max(best.get(i, -np.inf), float((own * v).sum()))
        everyone = sorted(best.items(), key=lambda b: (-b[1], b[0]))
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(abs(best[v] - s) < 1e-12 for _, v, s in found) and len({v for _, v, _ in found}) == 5
        # the index finds nearly all of the nearest five
        assert len({v for v, _ in everyone[:5]} & {v for _, v, _ in found}) >= 3


def test_session_without_a_shared_folder(spark, monkeypatch):
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: "local[2]" if name == "spark.master" else default))
    folder = common.shared_dir(unset)
    assert folder == common.shared_dir(unset)
    monkeypatch.setattr(common, "shared_dir", lambda _: folder)
    assert common.stage(spark.range(5), "t").count() == 5
    unset.conf.get = lambda name, default=None: "spark://host:7077" if name == "spark.master" else default
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        monkeypatch.undo()
        common.shared_dir(unset)
