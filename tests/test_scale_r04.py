"""Findings of round 4: whole windows in the store, arrays written by Arrow, packed training rows, the shuffled copy, words of a text."""

from __future__ import annotations

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import episode, frame
from panelspark.operators import sequences
from panelspark.plans import q_io
from panelspark.plans.pipelines import window_source
from panelspark.sources import io
from panelspark.spec import DEFAULT as S


def test_windows_of_the_round_trip_hold_all_features(spark, monkeypatch):
    """the windows written are whole, and a feature that comes back otherwise fails the job."""
    df = frame(spark, [episode(u, "2024-01-01", 22 + u % 9, 3 + u % 3) for u in range(1, 40)])
    monkeypatch.setattr(q_io, "episodes", lambda *a: df)
    seen = {}
    monkeypatch.setattr(io, "write_windows", lambda w, path, plain=io.write_windows: (plain(w, path), seen.update(path=path)))
    out = q_io.q_windows_roundtrip_21(spark, "")
    assert out.count() == sum(22 + u % 9 - 20 for u in range(1, 40))
    for n in (14, 21):
        shapes = spark.read.parquet(f"{seen['path']}/seq_length={n}").select(F.size("X"), F.size(F.col("X")[0])).distinct().collect()
        assert [tuple(r) for r in shapes] == [(n, len(S.input_features))]
    monkeypatch.setattr(io, "read_windows", lambda spark, path, n, plain=io.read_windows: plain(spark, path, n).withColumn("X", F.slice("X", 1, 20)))
    with pytest.raises(Exception, match="not those written"):
        q_io.q_windows_roundtrip_21(spark, "").collect()


def test_arrays_written_by_arrow_come_back(spark, tmpdir_path):
    """nulls, ragged and empty arrays, odd folder names; append and overwrite; a failed job changes nothing."""
    kind = "id long, d date, seq_length int, split string, X array<array<float>>, y_phase array<int>, y_reg array<float>"
    day = dt.date(2024, 1, 2)
    rows = [(1, day, 2, "train", [[1.0, None], [2.5, 3.5]], [1, None], [1.0, 2.0]), (2, None, 2, "a=b/c", [[1.0], []], [], None),
            (3, day, 3, None, None, None, [float("nan")]), (4, day, 3, "val", [None, [0.0]], [7], []), (None, day, 2, "val", [], [1], [2.0])]
    df, path = spark.createDataFrame(rows, kind).repartition(3), os.path.join(tmpdir_path, "w")
    plain = lambda d: sorted(map(repr, d.select("id", "d", "seq_length", "split", "X", "y_phase", "y_reg").collect()))
    io.write_windows(df, path)
    assert plain(spark.read.parquet(path)) == plain(df)
    assert sorted(x for x in os.listdir(path) if x[0] not in "._") == ["seq_length=2", "seq_length=3"]
    io.write_windows(df, path, "append")
    assert spark.read.parquet(path).count() == 10
    io.write_windows(df.filter("id < 3"), path)
    assert plain(spark.read.parquet(path)) == plain(df.filter("id < 3"))
    with pytest.raises(Exception, match="no window"):
        io.write_windows(df.withColumn("id", F.when(F.col("id") == 4, F.raise_error(F.lit("no window")).cast("long")).otherwise(F.col("id"))), path)
    assert plain(spark.read.parquet(path)) == plain(df.filter("id < 3"))  # what tasks of the failed job still write is skipped
    with pytest.raises(FileExistsError):
        io.write_windows(df, path, "error")


def test_training_rows_are_packed(spark, tmpdir_path):
    """F8, F9: windows kept as blocks of numbers give the sums of the plain arrays; the fit's stored rows hold no nested array."""
    from panelspark.operators import training
    from panelspark.operators.network import Network
    df = frame(spark, [episode(u, "2024-01-01", 22 + u % 9, 3 + u % 3) for u in range(1, 40)])
    w = sequences.window_arrays(sequences.windows(window_source(df), 21)).select("X", "y_phase", "y_reg", "split", F.lit(0).alias("shard")).cache()
    packed = training._packed(w, len(S.phase_names))
    assert not any(f.dataType.simpleString().startswith("array<array") for f in packed.schema)
    net = Network(len(S.input_features), len(S.phase_names), 4, 4, 10.0, 5.0)
    flat = net.initial(1)
    rows = w.collect()
    x, y, r = (np.array([v[c] for v in rows]) for c in ("X", "y_phase", "y_reg"))
    sums, gradient = training._pass(packed, net, flat, learn=True)
    want = net.gradient(flat, x, y, r)
    assert np.allclose(sums, want[0]) and np.allclose(gradient, want[1])
    assert np.allclose(training._pass(packed, net, flat, learn=False)[0], want[0])
    got = packed.agg(F.sum(F.col("rows") * F.col("steps")), F.sum("sum_r"), F.sum("sum_rr")).first()
    assert np.allclose(tuple(got), (y.size, r.sum(), (r * r).sum()))


def test_flattened_predictions_pad_and_skip_as_before(spark):
    from panelspark.operators.training import flatten_predictions
    kind = "split string, X array<array<float>>, y_phase array<int>, y_reg array<float>, probs array<array<double>>, pred_reg array<double>"
    rows = [("a", None, [1, 0], [2.0, 1.0], [[0.2, 0.8], [0.5, 0.5]], [2.5, 1.5]), ("b", None, None, [1.0], [[1.0]], [1.0]),
            ("c", None, [], [], [], []), ("d", None, [1], [2.0, 1.0], [[0.0, 1.0]], [2.0])]
    got = sorted(map(tuple, flatten_predictions(spark.createDataFrame(rows, kind)).select("split", "t", "y_phase", "y_reg", "pred_reg", "pred_label").collect()), key=repr)
    assert got == [("a", 0, 1, 2.0, 2.5, 1), ("a", 1, 0, 1.0, 1.5, 0), ("d", 0, 1, 2.0, 2.0, 1), ("d", 1, None, 1.0, None, None)]


def test_words_of_a_text_on_arrays():
    """the words found on code points are those of the pattern, and short words merge as the library does."""
    import random

    import regex
    from panelspark.llm import op08_bpe as op8
    pattern, rng = regex.compile(op8.WORDS), random.Random(7)
    letters = ["'", "'", "s", "t", "re", "ve", "m", "ll", "d", " ", " ", "\n", "\t", "x", "A", "9", "½", "²", "é", "漢", "\xa0", "\x1c", "\x85", "-", "😀", "\0", "_"]
    for _ in range(2000):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(3)]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        begins = np.cumsum([0] + [len(t) for t in texts[:-1]])
        want = [b + m.start() for t, b in zip(texts, begins.tolist(), strict=True) for m in pattern.finditer(t)]
        assert op8._starts_of_words(points, begins).tolist() == want, texts


def test_short_and_long_words_and_kept_words():
    """rounds over short words, the index of pairs over long ones and a full store of words give the same ids."""
    import random

    from panelspark.llm import op08_bpe as op8
    from panelspark.llm.queries import tokenizer_path
    rng = random.Random(3)
    words = [bytes(rng.choice(b"aabetns rth") for _ in range(rng.randint(0, 70))) for _ in range(400)]
    encoder = op8.PairIndexEncoder(op8.BpeFile.load(tokenizer_path(), op8.WORDS))
    ids, sizes = encoder.encode_words(words)
    ends = np.cumsum(sizes)
    for w, own in zip(words, np.split(ids, ends[:-1]), strict=True):
        if w:
            assert own.tolist() == encoder._encode_long([w])[0].tolist()
    texts = ["the rain the train", "<|endoftext|>", "a<|endoftext|>the", ""]
    first = encoder.encode(texts)
    again = encoder.encode(texts)
    assert first[0].tolist() == again[0].tolist() and first[1].tolist() == again[1].tolist() and first[1][3] == 0 and first[1][1] == 1


def test_scored_margins_are_worked_out_once(spark):
    """the exponentials and margins of the classifier stand once in the plan."""
    from panelspark.operators import forecast

    class Model:
        coefficientMatrix = type("M", (), {"toArray": staticmethod(lambda: np.eye(4)[:, :2])})
        interceptVector = type("V", (), {"toArray": staticmethod(lambda: np.zeros(4))})

    df = spark.createDataFrame([(1.0, 2.0), (3.0, 0.5)], "a double, b double")
    out = forecast.score_phase_classifier(Model, df, ["a", "b"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EXP(") == 4
    for r in out.collect():
        z = np.array([r.a, r.b, 0.0, 0.0])
        assert np.allclose(r.probs, np.exp(z) / np.exp(z).sum()) and r.pred_label == z.argmax()
    for bad in (None, float("nan")):
        with pytest.raises(Exception, match="null or NaN"):
            forecast.score_phase_classifier(Model, spark.createDataFrame([(bad, 1.0)], "a double, b double"), ["a", "b"]).collect()


def test_rows_shuffled_in_packs(spark):
    """every row once, all rows of a hash in one partition, and far fewer bytes than the rows one by one."""
    from panelspark.operators import layout
    rows = [(u, dt.date(2024, 1, 1 + d % 28) if d % 7 else None, f"text {u % 3}", None if u % 5 == 0 else u / 3) for u in range(300) for d in range(20)]
    df = spark.createDataFrame(rows, "u long, d date, s string, v double").repartition(3)
    out = layout.by_hash(df, ["u", "d"], 5, block=1000)
    assert out.schema.simpleString() == df.schema.simpleString() and out.rdd.getNumPartitions() == 5
    assert sorted(map(repr, out.collect())) == sorted(map(repr, df.collect()))
    assert out.withColumn("p", F.spark_partition_id()).groupBy("u", "d").agg(F.count_distinct("p").alias("n")).filter("n > 1").count() == 0
    assert layout.by_hash(df.filter("u < 0"), ["u"], 4).count() == 0
