"""GEN2-GEN5, AGG16: fixed-length sliding windows inside each episode.

Windows never cross episodes, slide by one row, are ordered by the day
column and count *rows* (an episode with fewer than L rows is skipped).

Plan: one ``collect_list`` per episode (its row count is the episode length
in days - DQ6 checks it equals the stated length), then every window is a
``slice`` of that array.  Grouping on (entity, start) reuses the partitioning
the daily panel inherits from the history step, so building windows adds no
shuffle; windows of several L come from the same collected arrays (GEN4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import DEFAULT, PanelSpec


def require_features(panel: DataFrame, features=None, spec: PanelSpec = DEFAULT) -> DataFrame:
    """PRJ16: raise if the panel lacks a window feature, target or key; PRJ15: no forbidden one among them."""
    features = list(features if features is not None else spec.input_features)
    spec.check_no_leakage(features)
    missing = [c for c in (*spec.episode_keys, *features, spec.label, spec.countdown) if c not in panel.columns]
    if missing:
        raise ValueError(f"panel lacks columns for windows: {missing}")
    return panel


def episode_rows(daily: DataFrame, features=None, spec: PanelSpec = DEFAULT,
                 order_col: str | None = None, keys=None) -> DataFrame:
    """Per episode: ``rows`` = array of struct(o, x, y, r) sorted by ``o`` (day).

    ``order_col`` defaults to the day column (use the raw day when the day
    feature is scaled - T14); ``x`` is the float feature vector (PRJ14/PRJ17).
    """
    features = list(features if features is not None else spec.input_features)
    keys = list(keys or spec.episode_keys)
    o = order_col or spec.day
    row = F.struct(F.col(o).alias("o"),
                   F.array(*[F.col(c).cast("float") for c in features]).alias("x"),
                   F.col(spec.label).cast("int").alias("y"),
                   F.col(spec.countdown).cast("float").alias("r"))
    extra = [c for c in ("split",) if c in daily.columns and c not in keys]
    return daily.groupBy(*keys, *extra).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def episode_rows_direct(ep: DataFrame, params: DataFrame, features, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Per-episode ``rows`` computed from the (split, scaled) episode row itself:
    day d = 0 .. length-1, the day feature scaled with the broadcast parameters,
    the other features episode-constant, label from the phase rule, countdown
    from the dates.  Row-local: no explode, no shuffle, no collect.

    Day and countdown arrays are ``sequence``s (whole-stage codegen); only the
    phase label - and the feature vector when features are requested - need a
    per-day lambda.  The arrays are zipped into the same struct layout as
    :func:`episode_rows`.
    """
    from .expand import phase_label

    n = F.col(spec.length)
    j = ep.crossJoin(F.broadcast(params.select(f"{spec.day}__scale", f"{spec.day}__offset")))
    span = F.datediff(F.col(spec.next_start), F.col(spec.start))
    sd, od = F.col(f"{spec.day}__scale"), F.col(f"{spec.day}__offset")
    guard = F.raise_error(F.lit("episode length must be positive"))
    days = F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(guard)
    # the constant features are worked out once per episode, not once per day (the explode of one struct keeps them apart)
    static = [c for c in features if c != spec.day]
    if static:
        j = j.withColumn("__s", F.explode(F.array(F.struct(*[F.col(c).cast("float").alias(c) for c in static]))))
    arrays = {
        "__o": days,
        # next - (start + d) for d = 0 .. n-1, counting down by one
        "__r": F.when(n >= 1, F.sequence(span, span - n + 1, F.lit(-1))).otherwise(guard)
        .cast("array<float>"),
        "__y": F.transform(days, lambda d: phase_label(d, spec.length, spec.prefix, spec.ovulation_offset)),
        "__x": F.transform(days, lambda d: F.array(*[
            (d.cast("double") * sd + od).cast("float") if c == spec.day else F.col("__s")[c] for c in features])),
    }
    j = j.withColumns(arrays)
    rows = F.arrays_zip(F.col("__o"), F.col("__x"), F.col("__y"), F.col("__r")).cast(
        "array<struct<o:int,x:array<float>,y:int,r:float>>")
    keys = [*spec.episode_keys] + (["split"] if "split" in ep.columns else [])
    return j.select(*keys, rows.alias("rows"))


def episode_sizes(daily: DataFrame, keys) -> DataFrame:
    """Rows per episode (map-side partial count): enough for GEN3 / AGG16 / DQ17."""
    return daily.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("__n"))


def episode_sizes_direct(ep: DataFrame, keys, spec: PanelSpec = DEFAULT) -> DataFrame:
    """The sizes the daily panel of ``ep`` would have, without exploding it (repeated episodes add up)."""
    from .expand import day_sequence
    return ep.groupBy(*keys).agg(F.sum(F.size(day_sequence(spec.length))).cast("int").alias("__n"))


def windows(ep_rows: DataFrame, lengths, keys=None, spec: PanelSpec = DEFAULT) -> DataFrame:
    """GEN2 + GEN4: one row per window: ``seq_length``, ``window_start`` (0-based row
    offset), ``win`` (slice of L row structs)."""
    lengths = [lengths] if isinstance(lengths, int) else list(lengths)
    keys = [c for c in ep_rows.columns if c != "rows"] if keys is None else list(keys)
    # lengths and starts are exploded and the slice is cut right behind them, in generated code: a window row that is
    # kept, moved or written never carries the whole episode
    per_l = ep_rows.select(*keys, "rows", F.explode(F.array(*[F.lit(int(x)) for x in lengths])).alias("seq_length"))
    last = F.size("rows") - F.col("seq_length")
    starts = per_l.filter(last >= 0).select(*keys, "seq_length", "rows", F.explode(F.sequence(F.lit(0), last)).alias("window_start"))
    return starts.select(*keys, "seq_length", "window_start",
                         F.slice("rows", F.col("window_start") + 1, F.col("seq_length")).alias("win"))


def _slices(rows: str, count: Column, L: int) -> Column:
    """The windows of ``L`` elements at the first ``count`` places of an array."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(
        F.lit(int(L)).alias("seq_length"), i.alias("window_start"), F.slice(rows, i + 1, L).alias("win")))


def windows_by_position(df: DataFrame, keys, coarse: str | list, order: list, L: int, fields: dict,
                        block: int | None = None) -> DataFrame:
    """GEN2 for groups of any size: windows of ``L`` consecutive rows per group.

    Skew-safe variant of ``episode_rows`` + ``windows`` for irregular groups (one
    group may hold a third of the data): a row's position is its count of earlier
    rows (running count; ``coarse``, a level or several, bounds the per-group window). Rows are
    gathered in blocks of ``block`` positions with the L - 1 rows behind them, so a row is
    shuffled 1 + (L - 1) / block times and no task needs more than a block of a group; each block cuts the windows
    that start in it. Groups with fewer than L rows have none. ``fields`` maps names to columns kept per row.
    """
    from .prefix import exclusive_running

    keys = list(keys)
    cols = list(dict.fromkeys([*keys, *([coarse] if isinstance(coarse, str) else coarse), *order]))
    base = df.select(*cols, *[(F.col(c) if isinstance(c, str) else c).alias(f"__f_{n}")
                              for n, c in fields.items()]).withColumn("__one", F.lit(1))
    pos = exclusive_running(base, keys, coarse, order, {"__p": "__one"}, counts=False)
    p = F.coalesce(F.col("__p_sum"), F.lit(0)).cast("int")
    row = F.struct(p.alias("p"), *[F.col(f"__f_{n}").alias(n) for n in fields])
    block = block or max(256, 16 * L)
    own = F.floor(p / F.lit(block)).cast("int")
    # rows at the head of a block end windows that start in the block before
    blocks = F.when((p % block < L - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    emitted = pos.select(*keys, row.alias("__r"), F.explode(blocks).alias("__b"))
    whole = emitted.groupBy(*keys, "__b").agg(F.array_sort(F.collect_list("__r")).alias("__rows"))
    starts = F.least(F.lit(block), F.size("__rows") - L + 1)
    cut = whole.filter(starts > 0).select(*keys, "__b", F.explode(_slices("__rows", starts, L)).alias("w"))
    return cut.select(*keys, (F.col("__b") * block + F.col("w.window_start")).alias("window_start"), "w.win", "w.seq_length")


def window_arrays(w: DataFrame) -> DataFrame:
    """The reference's tensors per window: X (L x F float), y_phase (L int), y_reg (L float)."""
    return w.withColumns({"X": F.col("win.x"), "y_phase": F.col("win.y"), "y_reg": F.col("win.r")}) \
        .drop("win")


def window_digest(w: DataFrame) -> DataFrame:
    """Comparable summary of each window: first/last day, label and countdown sums,
    md5 of the comma-joined labels. Windows have their rows as ``win``, or as the arrays of :func:`window_arrays` with ``day``."""
    days, labels, countdowns = (F.col(c) for c in (("win.o", "win.y", "win.r") if "win" in w.columns else ("day", "y_phase", "y_reg")))
    return w.withColumns({
        "first_day": days[0].cast("int"),
        "last_day": F.element_at(days, -1).cast("int"),
        "sum_label": F.aggregate(labels, F.lit(0).cast("long"), lambda a, y: a + y),
        "sum_countdown": F.aggregate(countdowns.cast("array<bigint>"), F.lit(0).cast("long"),
                                     lambda a, r: a + r),
        "labels_md5": F.md5(F.array_join(labels.cast("array<string>"), ",")),
    }).drop(*(["win"] if "win" in w.columns else ["day", "X", "y_phase", "y_reg"]))


def _window_sums(df: DataFrame, column: str, lengths, out: str) -> DataFrame:
    """Per length, ``<out>_<length>``: sums of that many neighbours at each start of an array of longs (null where they
    don't fit), from sums of 1, 2, 4, ... neighbours: a few passes over an episode, whatever its size."""
    def beside(a, b, gap):
        return F.zip_with(a, F.slice(b, F.lit(gap + 1), F.size(b)), lambda x, y: x + y)

    done, width = dict.fromkeys(lengths, 0), 1
    df = df.withColumn("__pow", F.col(column))
    while width <= max(lengths):
        df = df.withColumns({f"{out}_{n}": beside(f"{out}_{n}", "__pow", done[n]) if done[n] else F.col("__pow")
                             for n in done if n & width})
        done = {n: d + (n & width) for n, d in done.items()}
        width *= 2
        if width <= max(lengths):
            df = df.withColumn("__pow", beside("__pow", "__pow", width // 2))
    return df.drop("__pow", column)


def window_digest_from_rows(ep_rows: DataFrame, lengths, keys=None) -> DataFrame:
    """Same columns as ``window_digest(windows(ep_rows, L))``, but the per-element
    work (label strings, sums of neighbours) runs once per episode; each window then
    needs only array lookups, a slice and an md5 (all inside whole-stage codegen)."""
    lengths = [lengths] if isinstance(lengths, int) else list(lengths)
    keys = [c for c in ep_rows.columns if c != "rows"] if keys is None else list(keys)
    pre = ep_rows.select(
        *keys, F.size("rows").alias("__n"),
        # field extraction and array casts stay inside whole-stage codegen (no lambdas)
        F.col("rows.o").cast("array<int>").alias("__days"),
        F.col("rows.y").cast("array<string>").alias("__lab"),
        F.col("rows.y").cast("array<bigint>").alias("__y"),
        F.col("rows.r").cast("array<bigint>").alias("__r"))
    pre = _window_sums(_window_sums(pre, "__y", lengths, "__sy"), "__r", lengths, "__sr")
    per_l = pre.select("__n", "__days", "__lab", *keys, F.explode(F.array(*[F.struct(
        F.lit(int(x)).alias("seq_length"), F.col(f"__sy_{x}").alias("sy"), F.col(f"__sr_{x}").alias("sr")) for x in lengths])).alias("__l"))
    per_l = per_l.select("*", "__l.*").drop("__l").filter(F.col("__n") >= F.col("seq_length"))
    st = per_l.select("*", F.explode(F.sequence(F.lit(0), F.col("__n") - F.col("seq_length")))
                      .alias("window_start"))
    s, L = F.col("window_start"), F.col("seq_length")
    return st.select(
        *keys, "seq_length", "window_start",
        F.element_at("__days", s + 1).alias("first_day"),
        F.element_at("__days", s + L).alias("last_day"),
        F.element_at("sy", s + 1).alias("sum_label"),
        F.element_at("sr", s + 1).alias("sum_countdown"),
        F.md5(F.array_join(F.slice("__lab", s + 1, L), ",")).alias("labels_md5"))


def window_counts(ep_rows: DataFrame, lengths, keys=None) -> DataFrame:
    """GEN3 / AGG16 / DQ17: per (keys, L) episodes, skipped episodes, windows (the length of the start sequence that
    ``windows`` explodes) and the closed form sum(max(rows-L+1, 0)), in one pass.
    ``ep_rows`` has either the ``rows`` arrays or a ``__n`` row count per episode."""
    lengths = [lengths] if isinstance(lengths, int) else list(lengths)
    keys = list(keys or [])
    n = F.col("__n") if "__n" in ep_rows.columns else F.size("rows")
    per_l = ep_rows.select(*keys, n.cast("int").alias("__n"),
                           F.explode(F.array(*[F.lit(int(x)) for x in lengths])).alias("seq_length"))
    fits = F.col("__n") >= F.col("seq_length")
    starts = F.when(fits, F.size(F.sequence(F.lit(0), F.col("__n") - F.col("seq_length")))).otherwise(0)
    return per_l.groupBy(*keys, "seq_length").agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.sum((~fits).cast("long")).alias("n_skipped"),
        F.sum(F.greatest(F.col("__n") - F.col("seq_length") + 1, F.lit(0))).cast("long").alias("n_windows_expected"),
        F.sum(starts).cast("long").alias("n_windows"))


def flatten_windows(w: DataFrame) -> DataFrame:
    """GEN5: back to one row per (window, timestep)."""
    keys = [c for c in w.columns if c != "win"]
    return w.select(*keys, F.posexplode("win").alias("t", "row")) \
        .select(*keys, "t", F.col("row.o").alias("day"), F.col("row.y").alias("y_phase"),
                F.col("row.r").alias("y_reg"))


def timestep_weight(day, n_rows, L: int) -> Column:
    """How many length-L windows of an n-row episode contain row ``day`` (0-based):
    per-timestep metrics over overlapping windows equal day-level metrics with this
    weight (T12), without materialising the windows."""
    d = F.col(day) if isinstance(day, str) else day
    n = F.col(n_rows) if isinstance(n_rows, str) else n_rows
    hi = F.least(d, n - F.lit(L))
    lo = F.greatest(F.lit(0), d - F.lit(L - 1))
    return F.greatest(hi - lo + F.lit(1), F.lit(0)).cast("long")
