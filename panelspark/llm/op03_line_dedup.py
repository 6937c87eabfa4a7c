"""Line dedup by winnowing over line hashes (DataFrame functions only).

A *run* is a series of neighbouring lines (lines without a word don't count) that, normalised, also
stands at an earlier place; places are ordered by (id, text hash, line number). Runs of ``min_words``
words or more are repeated passages: the later one is deleted, the first one stays.

1. *Windows.* From each line a window goes forward, and one goes backward, to the nearest line at which it
   holds ``min_words`` words. Its extent depends on its lines only, so equal passages have equal windows.
2. *Winnowing.* Each window selects its line with the smallest hash (the first one on ties). Every run of
   ``min_words`` words holds a whole window, so its selected line is a fingerprint in both places: no such
   run is missed. Fingerprints that occur once in the corpus are dropped here; that is most of them.
3. *Positions.* The windows that selected a shared fingerprint are grouped by (fingerprint, its place in the
   window, hash of the window) and joined to the first place of that group.
4. *Extension.* A window that matched an earlier place is a seed. A run grows to the left and to the right
   as long as neighbouring seeds match; its lines are the union of its seeds. This is the maximal run:
   a line i of a repeated run a..b lies in the backward window ending at i if a..i holds enough words, else in
   the forward window from i if i..b does, else in the forward window from a, and all these lie inside a..b.

Scale: lines are paragraphs, so a line is a few longs. A group of copies costs one row per copy and
window (each is joined to the first place only, never to each other), grouping is partial on the map side,
and the join to the first place is an equi-join whose hot keys adaptive execution splits. The text is shuffled
once, to the deleted line numbers.

Edge cases: null and empty texts have no lines and stay; lines without a word are kept; rows that
repeat (same id and text) are one document, whose rows all get the same result; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lines_of, normal_line, stage, text_of, words_of

HAS_WORD = r"[^\x20\x09-\x0D]"


def _reach(words: Column, min_words: int) -> Column:
    """How many elements from the front hold ``min_words`` words together; null if all hold fewer."""
    return F.aggregate(
        words, F.struct(F.lit(0).alias("w"), F.lit(0).alias("k")),
        lambda a, x: F.when(a["w"] < min_words, F.struct((a["w"] + x).alias("w"), (a["k"] + 1).alias("k"))).otherwise(a),
        lambda a: F.when(a["w"] >= min_words, a["k"]))


def window_rows(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """One row per window: _id, _ck, a, b (its first and last line among those with a word), ra, rb (their raw
    numbers), p (number of the selected
    line), f (its hash), o (its place in the window), g (hash of the window)."""
    df = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("_text"))
    raw = F.transform(lines_of(F.col("_text")), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    df = df.select("_id", F.xxhash64("_text").alias("_ck"), F.transform(
        F.filter(raw, lambda r: F.rlike(r["x"], F.lit(HAS_WORD))),
        lambda r: F.struct(r["i"].alias("i"), F.xxhash64(normal_line(r["x"])).alias("h"),
                           F.size(words_of(r["x"])).alias("w"))).alias("_ls"))
    # arrays of their own, not fields of _ls: a field would be taken out again for each element below
    df = df.select("_id", "_ck", *[F.expr(f"transform(_ls, r -> r.{c})").alias(f"_{c}") for c in "ihw"])
    # a window of W words has at most W lines, as each has a word
    ahead = F.transform("_w", lambda w, j: F.struct(
        j.alias("a"), (j + _reach(F.slice(F.col("_w"), j + 1, F.lit(min_words)), min_words) - 1).alias("b")))
    back = F.transform("_w", lambda w, j: F.struct(
        (j - _reach(F.reverse(F.slice(F.col("_w"), F.greatest(j + 2 - min_words, F.lit(1)),
                                      F.least(j + 1, F.lit(min_words)))), min_words) + 1).alias("a"), j.alias("b")))
    df = df.withColumn("_win", F.filter(F.concat(ahead, F.filter(back, lambda r: r["a"] < r["b"])),
                                        lambda r: r["a"].isNotNull() & r["b"].isNotNull()))
    # the outer form, as plain explode() makes Catalyst compute the array once more to drop empty ones early
    df = df.select("_id", "_ck", "_i", "_h", F.explode_outer("_win").alias("r")).filter(F.col("r").isNotNull())
    df = df.withColumn("_s", F.slice(F.col("_h"), F.col("r.a") + 1, F.col("r.b") - F.col("r.a") + 1))
    df = df.withColumn("f", F.array_min("_s")).withColumn("o", F.array_position("_s", F.col("f")).cast("int"))
    return df.select("_id", "_ck", "r.a", "r.b", F.get("_i", F.col("r.a")).alias("ra"), F.get("_i", F.col("r.b")).alias("rb"),
                     (F.col("r.a") + F.col("o") - 1).alias("p"), "f", "o", F.xxhash64("_s").alias("g"))


def repeated_runs(windows: DataFrame) -> DataFrame:
    """(d_id, d_ck, runs): per document with a repeated run, the sorted maximal runs (a, b) to delete."""
    # fingerprints at two places or more; min and max of the place tell, and combine before the shuffle
    place = F.struct("_id", "_ck", "p")
    shared = (windows.groupBy("f").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
              .filter(F.col("lo") != F.col("hi")).select(F.col("f").alias("s_f")))
    shared = windows.join(shared, F.col("f") == F.col("s_f"), "left_semi")
    first = (shared.groupBy("f", "o", "g").agg(F.min(F.struct("_id", "_ck", "a")).alias("first"))
             .select(F.col("f").alias("k_f"), F.col("o").alias("k_o"), F.col("g").alias("k_g"), "first"))
    seeds = (shared.join(first, (F.col("f") == F.col("k_f")) & (F.col("o") == F.col("k_o")) & (F.col("g") == F.col("k_g")))
             .filter(F.struct("_id", "_ck", "a") > F.col("first"))
             .groupBy("_id", "_ck", "a").agg(F.max("b").alias("b"), F.min("ra").alias("ra"), F.max("rb").alias("rb")))
    # extension: overlapping or touching seeds of a document make one run; a group is one document's lines
    w = W.partitionBy("_id", "_ck").orderBy("a")
    runs = (seeds.withColumn("_far", F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1)))
            .withColumn("_new", F.when(F.col("a") <= F.col("_far") + 1, 0).otherwise(1))
            .withColumn("_run", F.sum("_new").over(w))
            .groupBy("_id", "_ck", "_run").agg(F.min("ra").alias("a"), F.max("rb").alias("b")))
    return (runs.groupBy("_id", "_ck").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))
            .select(F.col("_id").alias("d_id"), F.col("_ck").alias("d_ck"), "runs"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 50) -> DataFrame:
    """``docs`` with four columns more: ``clean_text``, ``n_lines`` and ``deleted_lines`` (lines with a word),
    ``deleted_runs`` (array of first and last raw line number). Columns of these names are replaced."""
    windows = stage(window_rows(docs, id_col, text_col, min_words), "op3-windows")
    runs = repeated_runs(windows)
    keep = [c for c in docs.columns if c.lower() not in ("clean_text", "n_lines", "deleted_lines", "deleted_runs")]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(f"`{id_col}`").alias("_id"),
                     text_of(text_col).alias("_text"))
    df = df.withColumn("_ck", F.xxhash64("_text")).join(
        runs, F.col("_id").eqNullSafe(F.col("d_id")) & (F.col("_ck") == F.col("d_ck")), "left")
    df = df.withColumn("_lines", lines_of(F.col("_text")))
    df = df.withColumn("_runs", F.coalesce("runs", F.array().cast(runs.schema["runs"].dataType)))
    # what stands before each run and after the last one
    end = lambda j: F.coalesce(F.get(F.col("_runs"), j - 1)["b"], F.lit(-1))
    rest = F.coalesce(F.array_max("_runs.b"), F.lit(-1))
    left = F.concat(F.flatten(F.transform("_runs", lambda r, j: F.slice(F.col("_lines"), end(j) + 2, r["a"] - end(j) - 1))),
                    F.slice(F.col("_lines"), rest + 2, F.size("_lines") - rest - 1))
    df = df.withColumn("_left", F.when(F.size("_runs") > 0, left).otherwise(F.col("_lines")))
    marked = lambda c: F.size(F.filter(c, lambda x: F.rlike(x, F.lit(HAS_WORD)))).cast("long")
    return df.select("_row.*", F.when(F.size("_runs") > 0, F.array_join("_left", "\n")).otherwise(F.col("_text")).alias("clean_text"),
                     marked("_lines").alias("n_lines"), (marked("_lines") - marked("_left")).alias("deleted_lines"),
                     F.col("_runs").alias("deleted_runs"))
