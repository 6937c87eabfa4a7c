"""SPL1-SPL2, JN1-JN2, SET1-SET2: exact-count entity-level split.

Entities are ranked by ``md5("<seed>:<id>")`` (ties by id) and cut at
``rint(n * ratio)`` (Python's half-even ``round``), the remainder going to test.

No single-task sort: a global rank is the number of entities in earlier hash
buckets (65,536 buckets on the first four hex digits, a table whose size does
not grow with the data) plus a ``row_number`` inside the bucket.  The panel
itself is never joined to the membership table: the two cut keys are
collected into a one-row frame and every panel row compares its own hash to
them, so the split is row-local on the big side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import DEFAULT, SPLIT_RATIOS, SPLIT_SEED, PanelSpec

SPLITS = ("train", "val", "test")


def entity_hash(entity: str, seed: int = SPLIT_SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(entity).cast("string")))


def check_ratios(ratios) -> None:
    """DQ15 (first half): ratios must sum to 1 within 1e-9."""
    if abs(sum(ratios) - 1.0) >= 1e-9:
        raise ValueError(f"split ratios must sum to 1, got {sum(ratios)!r}")


def split_sizes(n: Column, ratios=SPLIT_RATIOS):
    n_train = F.rint(n.cast("double") * F.lit(float(ratios[0]))).cast("long")
    n_val = F.rint(n.cast("double") * F.lit(float(ratios[1]))).cast("long")
    # extreme ratios: rounding may overshoot n, so cuts are clamped (T13)
    n_train = F.least(n_train, n)
    n_val = F.least(n_val, n - n_train)
    return n_train, n_val


def entity_ranks(df: DataFrame, spec: PanelSpec = DEFAULT, seed: int = SPLIT_SEED) -> DataFrame:
    """SET2 + global rank of every distinct entity: (entity, __h, rank, n)."""
    ents = df.select(spec.entity).distinct().withColumn("__h", entity_hash(spec.entity, seed))
    ents = ents.withColumn("__b", F.conv(F.substring("__h", 1, 4), 16, 10).cast("int"))
    counts = ents.groupBy("__b").agg(F.count(F.lit(1)).alias("__c"))
    # at most 65,536 rows whatever the data size: a single ordered window is fine here
    w_all = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__b", F.coalesce(F.sum("__c").over(w_all), F.lit(0)).alias("__before"),
                            F.sum("__c").over(Window.partitionBy()).alias("n"))
    w_in = Window.partitionBy("__b").orderBy("__h", spec.entity)
    ranked = ents.join(F.broadcast(offsets), "__b")  # bounded: <= 65,536 rows
    return ranked.select(spec.entity, "__h", (F.col("__before") + F.row_number().over(w_in))
                         .alias("rank"), "n")


def split_membership(df: DataFrame, spec: PanelSpec = DEFAULT, ratios=SPLIT_RATIOS,
                     seed: int = SPLIT_SEED) -> DataFrame:
    """SPL1: one row per entity with its split (and rank)."""
    check_ratios(ratios)
    r = entity_ranks(df, spec, seed)
    n_train, n_val = split_sizes(F.col("n"), ratios)
    split = (F.when(F.col("rank") <= n_train, "train")
             .when(F.col("rank") <= n_train + n_val, "val").otherwise("test"))
    return r.select(spec.entity, split.alias("split"), "rank", "__h")


def split_cuts(membership: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """One row: the largest (hash, id) key of train and of train+val, plus sizes."""
    key = F.struct(F.col("__h").alias("h"), F.col(spec.entity).alias("id"))
    return membership.agg(
        F.max(F.when(F.col("split") == "train", key)).alias("cut_train"),
        F.max(F.when(F.col("split") != "test", key)).alias("cut_val"),
        F.count(F.lit(1)).alias("n_entities"))


def _le(h: Column, i: Column, cut: Column) -> Column:
    # (h, i) <= cut, false when the cut is null (an empty split)
    return F.coalesce((h < cut["h"]) | ((h == cut["h"]) & (i <= cut["id"])), F.lit(False))


def assign_split(df: DataFrame, cuts: DataFrame, spec: PanelSpec = DEFAULT,
                 seed: int = SPLIT_SEED) -> DataFrame:
    """JN1 without a shuffle: compare each row's own hash with the broadcast cut keys
    (``cuts`` has exactly one row, so the broadcast is bounded)."""
    h = entity_hash(spec.entity, seed)
    j = df.crossJoin(F.broadcast(cuts.select("cut_train", "cut_val")))
    i = F.col(spec.entity)
    split = (F.when(_le(h, i, F.col("cut_train")), "train")
             .when(_le(h, i, F.col("cut_val")), "val").otherwise("test"))
    return j.withColumn("split", split).drop("cut_train", "cut_val")


def split_panel(df: DataFrame, spec: PanelSpec = DEFAULT, ratios=SPLIT_RATIOS,
                seed: int = SPLIT_SEED) -> DataFrame:
    """Entity split of a panel: membership on distinct entities -> cuts -> row-local label."""
    cuts = split_cuts(split_membership(df, spec, ratios, seed), spec)
    return assign_split(df, cuts, spec, seed)


def split_overlap(split_df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """JN2 / SET1 in one pass: per pair of splits the entities found in both, and
    coverage (entities in any split). All overlaps must be 0 (DQ15)."""
    per = split_df.groupBy(spec.entity).agg(
        *[F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS])
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    wide = per.agg(*[F.sum(F.col(a) * F.col(b)).cast("long").alias(f"{a}&{b}") for a, b in pairs],
                   F.count(F.lit(1)).alias("covered"))
    return wide.unpivot([], [f"{a}&{b}" for a, b in pairs] + ["covered"], "pair", "n_entities")


def split_params(ratios=SPLIT_RATIOS, seed: int = SPLIT_SEED):
    """SPL2: the parameters returned with the split, as columns."""
    return [F.lit(float(ratios[0])).alias("train_ratio"), F.lit(float(ratios[1])).alias("val_ratio"),
            F.lit(float(ratios[2])).alias("test_ratio"), F.lit(int(seed)).alias("random_state")]
