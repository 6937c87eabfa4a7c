"""AGG1-AGG15, SRT3-SRT4, PRJ20: the exploratory profile as distributed aggregations.

Every statistic is one ``agg`` (partial on the map side, merged after one
small shuffle); wide results are unpivoted to (column_name, ...) rows.
Quantiles are exact and distributed (:func:`quantiles`): values are counted
per distinct value, ranks are located in range buckets and then inside the
bucket that holds them, so no column meets in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import round_half_even
from ..session import materialize
from ..spec import DEFAULT, PanelSpec


def _number(c):
    """A column as double; NaN counts as missing."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _long(df: DataFrame, columns) -> DataFrame:
    """(column_name, x) for the present values of numeric columns."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), _number(c).alias("x")) for c in columns]))
    return df.select(cells.alias("v")).select("v.*").filter(F.col("x").isNotNull())


def quantiles(df: DataFrame, columns, qs, buckets: int = 4096) -> DataFrame:
    """Exact quantiles with linear interpolation: (column_name, q<i> for each of ``qs``).

    One shuffle counts equal values (pre-aggregated on the map side); the rest reads that result. ``buckets`` equal
    ranges per column get a running count, which names the bucket of every wanted rank; only the values of these
    buckets are sorted, each bucket in a task of its own (the window spills). Broadcast are the ranges (one row a
    column) and the wanted ranks (two rows a column and quantile).
    """
    counts = _long(df, columns).groupBy("column_name", "x").agg(F.count(F.lit(1)).alias("c"))
    rng = counts.groupBy("column_name").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("c").alias("n"))
    share = F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    placed = counts.join(F.broadcast(rng), "column_name").select(
        "column_name", "x", "c", F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int").alias("b"))

    earlier = Window.partitionBy("column_name").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("column_name", "b").agg(F.sum("c").alias("bc"))  # at most ``buckets`` rows a column
    totals = totals.withColumn("before", F.coalesce(F.sum("bc").over(earlier), F.lit(0)))

    pos = F.col("q.at") * (F.col("n") - 1)
    want = rng.select("column_name", "n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("at")) for i, q in enumerate(qs)])).alias("q"))
    want = want.select("column_name", F.col("q.i").alias("i"), (pos - F.floor(pos)).alias("part"),
                       F.explode(F.array(F.struct(F.lit(0).alias("upper"), F.floor(pos).alias("k")),
                                         F.struct(F.lit(1).alias("upper"), F.ceil(pos).alias("k")))).alias("r"))
    want = want.select("column_name", "i", "part", "r.upper", "r.k").join(totals, "column_name") \
        .filter((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("bc"))).drop("bc")

    inside = Window.partitionBy("column_name", "b").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    named = want.select("column_name", "b").distinct()
    ranked = placed.join(F.broadcast(named), ["column_name", "b"]) \
        .withColumn("below", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    first = F.col("before") + F.col("below")
    hit = ranked.join(F.broadcast(want), ["column_name", "b"]) \
        .filter((F.col("k") >= first) & (F.col("k") < first + F.col("c")))
    both = hit.groupBy("column_name", "i", "part").agg(
        F.max(F.when(F.col("upper") == 0, F.col("x"))).alias("x0"),
        F.max(F.when(F.col("upper") == 1, F.col("x"))).alias("x1"))
    value = F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("part")
    return both.groupBy("column_name").agg(*[F.max(F.when(F.col("i") == i, value)).alias(f"q{i}")
                                             for i in range(len(qs))])


def episodes_per_entity(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """AGG1."""
    return df.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("n_episodes"))


def entity_overview(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """AGG2: entities, rows, mean (2 dp, half-even) / min / median / max episodes per entity."""
    per = episodes_per_entity(df, spec)
    head = per.agg(F.count(F.lit(1)).alias("n_entities"),
                   F.sum("n_episodes").alias("n_rows"),
                   round_half_even(F.avg("n_episodes"), 2).alias("mean_per_entity"),
                   F.min("n_episodes").alias("min_per_entity"),
                   F.max("n_episodes").alias("max_per_entity"))
    median = quantiles(per, ["n_episodes"], [0.5]).select(F.col("q0").alias("median_per_entity"))
    return head.join(median, F.lit(True), "left")  # one row each; no median without entities


def describe(df: DataFrame, columns, digits: int = 2) -> DataFrame:
    """AGG3: count, mean, sample std, min, 25/50/75 % (linear), max, rounded half-even. NaN counts as missing."""
    columns = list(columns)
    aggs = []
    for c in columns:
        x = _number(c)
        aggs.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("count"), F.avg(x).alias("mean"),
                             F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")).alias(c))
    rows = df.agg(*aggs).select(F.explode(F.array(*[F.col(c) for c in columns])).alias("s")).select("s.*")
    rows = rows.join(quantiles(df, columns, (0.25, 0.5, 0.75)), "column_name", "left")
    names = {"mean": "mean", "std": "std", "min": "min", "q0": "p25", "q1": "p50", "q2": "p75", "max": "max"}
    return rows.select("column_name", "count", *[round_half_even(F.col(k), digits).alias(v) for k, v in names.items()])


def describe_approx(df: DataFrame, columns, digits: int = 2) -> DataFrame:
    """:func:`describe` in one pass: the quartiles are values near the wanted rank (relative rank error 1e-5), not interpolated."""
    columns, names = list(columns), ("p25", "p50", "p75")
    cells = _long(df, columns).groupBy("column_name").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
        F.percentile_approx("x", [0.25, 0.5, 0.75], 100000).alias("q"), F.max("x").alias("max"))
    near = {n: F.col("q")[i] for i, n in enumerate(names)}
    values = {"mean": F.col("mean"), "std": F.col("std"), "min": F.col("min"), **near, "max": F.col("max")}
    return cells.select("column_name", "count", *[round_half_even(v, digits).alias(n) for n, v in values.items()])


def missing_values(df: DataFrame, columns=None, digits: int = 2) -> DataFrame:
    """AGG5: missing count and percent per column (NaN counts as missing)."""
    columns = list(columns or df.columns)
    types = dict(df.dtypes)

    def miss(c):
        m = F.col(c).isNull()
        if types[c] in ("double", "float"):
            m = m | F.isnan(c)
        return F.sum(m.cast("long"))

    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[miss(c).alias(c) for c in columns])
    long = wide.unpivot(["__n"], columns, "column_name", "n_missing")
    return long.select("column_name", "n_missing",
                       round_half_even(F.col("n_missing") * F.lit(100.0) / F.col("__n"), digits)
                       .alias("pct_missing"))


#: Repeated fingerprints (24 bytes each) up to this number are broadcast; beyond it they are joined by a shuffle.
BROADCAST_FINGERPRINTS = 1_000_000


def duplicate_rows(df: DataFrame, broadcast_up_to: int = BROADCAST_FINGERPRINTS) -> DataFrame:
    """AGG4: repeats beyond the first occurrence of a full row (nulls equal).

    First 128-bit fingerprints are counted, so 24 bytes a row are shuffled and whole rows stay where they are. Only
    rows whose fingerprint repeats are then compared in full: equal fingerprints don't make rows equal (a null leaves
    a hash as it is, and hashes may collide). Equal rows are counted before their shuffle, however many there are."""
    df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # any names
    # a null leaves a hash as it is, so the places of the nulls are hashed as well
    places = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in df.columns])
    prints = df.withColumns({"a": F.xxhash64(*df.columns, places), "b": F.xxhash64(F.lit(7), places, *df.columns)})
    again = materialize(prints.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("a", "b"))
    few = again.limit(broadcast_up_to + 1).count() <= broadcast_up_to
    same = prints.join(F.broadcast(again) if few else again, ["a", "b"], "left_semi")
    g = same.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_duplicate_rows"))


def value_counts(df: DataFrame, column: str, source: str | None = None) -> DataFrame:
    """AGG6 (null included as its own value)."""
    out = df.groupBy(F.col(column).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    out = out.select(F.lit(column).alias("column_name"), "value", "n_rows")
    return out if source is None else out.withColumn("source", F.lit(source))


def distinct_values(df: DataFrame, columns) -> DataFrame:
    """AGG7: one row per column and distinct non-null value, with the column's number of them."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                                for c in columns]))
    values = df.select(cells.alias("v")).select("v.*").filter(F.col("value").isNotNull()).distinct()
    n = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    return values.join(F.broadcast(n), "column_name")  # one row per column


def entity_stats(df: DataFrame, spec: PanelSpec = DEFAULT, digits: int = 6, means: dict | None = None) -> DataFrame:
    """AGG8: per entity mean/std of length (std of one row -> 0), mean of prefix, means of the
    context columns ``means`` (output name -> column; the default panel's stress and sleep), and episode count."""
    means = {"mean_stress": "stress_level", "mean_sleep": "sleep_hours"} if means is None else means
    r = lambda e: F.round(e, digits)
    return df.groupBy(spec.entity).agg(
        r(F.avg(spec.length)).alias("mean_cycle_length"),
        r(F.coalesce(F.stddev_samp(spec.length), F.lit(0.0))).alias("std_cycle_length"),
        r(F.avg(spec.prefix)).alias("mean_period_length"),
        *[r(F.avg(c)).alias(name) for name, c in means.items()],
        F.count(spec.length).alias("n_cycles"))


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """SRT3: top-k by ``by`` descending, ties by ``tie`` (TakeOrderedAndProject)."""
    return df.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(k)


def pearson_matrix(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    """AGG9: lower triangle of the Pearson matrix, pairwise complete.

    ``corr`` raises DIVIDE_BY_ZERO under ANSI on a constant column even inside a
    ``when``; ``try_divide(covar_pop, stddev_pop * stddev_pop)`` over the rows
    where both are present gives null instead.
    """
    aggs, names = [], []
    for i, a in enumerate(columns):
        for b in columns[:i]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            xa = F.when(both, F.col(a).cast("double"))
            xb = F.when(both, F.col(b).cast("double"))
            r = F.try_divide(F.covar_pop(xa, xb), F.stddev_pop(xa) * F.stddev_pop(xb))
            name = f"{a}|{b}"
            aggs.append(F.round(r, digits).alias(name))
            names.append(name)
    long = df.agg(*aggs).unpivot([], names, "pair", "r")
    return long.select(F.split("pair", r"\|")[0].alias("column_a"),
                       F.split("pair", r"\|")[1].alias("column_b"), "r")


def comoments(df: DataFrame, columns) -> DataFrame:
    """Mergeable co-moments of every pair of columns over the rows where both are present, nulls and NaN left out: one row
    per task and pair with n, both means, both sums of squared deviations and the sum of their products.

    One pass whatever the number of columns: a task keeps k x k matrices and merges its batches pairwise, so large
    means don't cost digits. The table has tasks x k (k + 1) / 2 rows."""
    columns = list(columns)
    k = len(columns)

    def merged(one: tuple, two: tuple) -> tuple:
        n = one[0] + two[0]
        share = np.divide(two[0], n, out=np.zeros((k, k)), where=n > 0)
        da, db = two[1] - one[1], two[2] - one[2]
        weight = one[0] * share
        return n, one[1] + da * share, one[2] + db * share, one[3] + two[3] + da * da * weight, \
            one[4] + two[4] + db * db * weight, one[5] + two[5] + da * db * weight

    def of_rows(x: np.ndarray) -> tuple:
        there = ~np.isnan(x)
        shift = np.nan_to_num(x[there.argmax(axis=0), np.arange(k)])  # a value of the column, so a constant one stays exact
        m, z = there.astype(float), np.where(there, x - shift, 0.0)
        n, sa, qa = m.T @ m, z.T @ m, (z * z).T @ m
        safe = np.maximum(n, 1)
        ma, mb = sa / safe, (sa / safe.T).T
        return n, ma + shift[:, None], mb + shift[None, :], qa - sa * ma, qa.T - (sa * ma).T, z.T @ z - sa * mb

    def run(batches):
        total = (np.zeros((k, k)),) * 6
        for batch in batches:
            if batch.num_rows:
                total = merged(total, of_rows(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])))
        a, b = np.tril_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *(pa.array(t[a, b]) for t in total)],
                                         names=["a", "b", "n", "ma", "mb", "qa", "qb", "c"])

    return df.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(
        run, "a int, b int, n double, ma double, mb double, qa double, qb double, c double")


def pearson_from_comoments(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    """AGG9 for many columns: the same rows as :func:`pearson_matrix`, by merging :func:`comoments`; the plan does not
    grow with the number of pairs."""
    columns = list(columns)
    parts = materialize(comoments(df, columns))
    mean = parts.groupBy("a", "b").agg(F.sum("n").alias("_n"), F.try_divide(F.sum(F.col("n") * F.col("ma")), F.sum("n")).alias("_ma"),
                                       F.try_divide(F.sum(F.col("n") * F.col("mb")), F.sum("n")).alias("_mb"))
    da, db = F.col("ma") - F.col("_ma"), F.col("mb") - F.col("_mb")
    full = parts.join(mean, ["a", "b"]).groupBy("a", "b").agg(
        *[F.max(c).alias(c) for c in ("_n", "_ma", "_mb")], F.sum(F.col("qa") + F.col("n") * da * da).alias("qa"), F.sum(F.col("qb") + F.col("n") * db * db).alias("qb"),
        F.sum(F.col("c") + F.col("n") * da * db).alias("c"))
    name = lambda i: F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(i) + 1)
    # what the rounding of a mean leaves of a constant column is no variation
    varies = lambda q, m: F.when(F.col(q) > F.col("_n") * F.pow(F.col(m) * 1e-13, F.lit(2)), F.col(q))
    r = F.round(F.try_divide("c", F.sqrt(varies("qa", "_ma")) * F.sqrt(varies("qb", "_mb"))), digits)
    return full.filter(F.col("a") > F.col("b")).select(name("a").alias("column_a"), name("b").alias("column_b"), r.alias("r"))


def histogram(df: DataFrame, columns, bins: int = 20) -> DataFrame:
    """AGG10: equal-width bins between min and max, last bin closed, empty bins kept
    (a constant column gets the range min-0.5 .. max+0.5, like numpy)."""
    spark: SparkSession = df.sparkSession
    rng = df.agg(*[F.struct(F.min(_number(c)).alias("lo"), F.max(_number(c)).alias("hi")).alias(c) for c in columns])
    rng = rng.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("m"))
                                         for c in columns])).alias("s")) \
        .select("s.column_name",
                F.when(F.col("s.m.lo") == F.col("s.m.hi"), F.col("s.m.lo") - 0.5)
                .otherwise(F.col("s.m.lo")).alias("lo"),
                F.when(F.col("s.m.lo") == F.col("s.m.hi"), F.col("s.m.hi") + 0.5)
                .otherwise(F.col("s.m.hi")).alias("hi"))
    # one row per column: broadcast is bounded by the number of profiled columns
    vals = _long(df, columns)
    j = vals.join(F.broadcast(rng), "column_name")
    b = F.least(F.floor((F.col("x") - F.col("lo")) * F.lit(float(bins)) / (F.col("hi") - F.col("lo"))),
                F.lit(bins - 1)).cast("int")
    counts = j.groupBy("column_name", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = rng.crossJoin(spark.range(bins).select(F.col("id").cast("int").alias("bin")))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return grid.join(counts, ["column_name", "bin"], "left").select(
        "column_name", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def discrete_histogram(df: DataFrame, column: str) -> DataFrame:
    """AGG11: count per integer value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def boxplot_stats(df: DataFrame, columns, whis: float = 1.5) -> DataFrame:
    """AGG12: quartiles, whiskers at the last data point inside whis*IQR, outlier count."""
    qs = quantiles(df, columns, (0.25, 0.5, 0.75)).select(
        "column_name", F.col("q0").alias("q1"), F.col("q1").alias("med"), F.col("q2").alias("q3"))
    vals = _long(df, columns)
    j = vals.join(F.broadcast(qs), "column_name")  # one row per column
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - F.lit(whis) * iqr, F.col("q3") + F.lit(whis) * iqr
    return j.groupBy("column_name", "q1", "med", "q3").agg(
        F.min(F.when(F.col("x") >= lo_f, F.col("x"))).alias("whisker_lo"),
        F.max(F.when(F.col("x") <= hi_f, F.col("x"))).alias("whisker_hi"),
        F.sum(((F.col("x") < lo_f) | (F.col("x") > hi_f)).cast("long")).alias("n_outliers"))


def monthly_counts(df: DataFrame, date_col: str) -> DataFrame:
    """AGG13: rows per calendar month (months without rows stay absent)."""
    return df.groupBy(F.date_format(date_col, "yyyy-MM").alias("year_month")).agg(
        F.count(F.lit(1)).alias("n_starts"))


def date_span(df: DataFrame, date_col: str) -> DataFrame:
    """AGG14."""
    return df.agg(F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date")) \
        .withColumn("span_days", F.datediff("last_date", "first_date"))


def static_feature_check(df: DataFrame, columns, spec: PanelSpec = DEFAULT) -> DataFrame:
    """AGG15: max over entities of the distinct non-null values per entity. Equal (entity, column, value) cells are
    merged on the map side, so the shuffle holds distinct values, not rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                                for c in columns]))
    values = df.select(spec.entity, cells.alias("v")).select(spec.entity, "v.*").distinct()
    per = values.groupBy(spec.entity, "column_name").agg(F.count("value").alias("k"))
    return per.groupBy("column_name").agg(F.max("k").alias("max_unique_values_per_user"))


def low_record_entities(df: DataFrame, k: int = 3, spec: PanelSpec = DEFAULT) -> DataFrame:
    """PRJ20: entities with at most k episodes."""
    return episodes_per_entity(df, spec).filter(F.col("n_episodes") <= k)
