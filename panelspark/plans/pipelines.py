"""The reference's entry points as lazy plans.

A: raw episodes -> clean -> history -> encode -> daily panel.
B: daily panel -> entity split -> train-only scaling -> windows of L days.
C: windows / panel -> forecast -> evaluation report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..operators.encode import encode_categories
from ..operators.quality import require_stage
from ..operators.scale import apply_minmax, fit_minmax
from ..operators.sequences import episode_rows_direct
from ..operators.split import assign_split, split_cuts, split_membership
from ..operators.expand import expand_days
from ..operators.history import add_history
from ..session import materialize
from ..spec import DEFAULT, PanelSpec


#: Days that one task gets when episodes are exploded. A shuffle of episodes is sized by its own bytes, which are about
#: 1/37 of what a task then sorts, caches or collects.
DAYS_PER_TASK = 1 << 19


def day_partitions(days: int | None, spark: SparkSession) -> int:
    """Partitions for so many days."""
    return max(spark.sparkContext.defaultParallelism, -(-(days or 0) // DAYS_PER_TASK))


def days_of(episodes: DataFrame, spec: PanelSpec = DEFAULT) -> int:
    """Days that the episodes will have when exploded."""
    return episodes.agg(F.sum(F.col(spec.length).cast("long"))).first()[0] or 0


def spread(ep: DataFrame, episodes: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Prepared episodes in partitions sized for their days, by (entity, start); ``episodes`` is what they were prepared
    from, which has the same lengths."""
    return ep.repartition(day_partitions(days_of(episodes, spec), ep.sparkSession), *spec.episode_keys)


def daily_panel(episodes: DataFrame, spec: PanelSpec = DEFAULT, encode: bool = True) -> DataFrame:
    """Entry A as one plan: history before the explode; encodings are episode-constant,
    so they run on episodes (one row per episode instead of one per day)."""
    ep = add_history(episodes, spec)
    if encode:
        ep = encode_categories(ep, spec)
    return expand_days(ep, spec)


def daily_for_sink(episodes: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """The daily panel laid out for SNK1: the *episode* table is range-partitioned
    on (entity, start) (sampled bounds spread a large entity over several
    partitions, as many as the days need), then exploded and sorted within partitions
    - ordered output files with a shuffle of episodes, not of the ~37x more daily rows."""
    ep = encode_categories(add_history(episodes, spec), spec)
    ep = ep.repartitionByRange(day_partitions(days_of(episodes, spec), ep.sparkSession), spec.entity, spec.start)
    return expand_days(ep, spec).sortWithinPartitions(spec.entity, spec.start, spec.day)


def ordered_daily(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """The daily panel in the sink column order; a missing column is an error."""
    missing = [c for c in spec.daily_columns if c not in panel.columns]
    if missing:
        raise ValueError(f"daily panel lacks columns: {missing}")
    return panel.select(*spec.daily_columns)


def prepared_episodes(episodes: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Episode table with history features and encodings (everything episode-constant)."""
    return encode_categories(add_history(episodes, spec), spec)


def split_episodes(ep: DataFrame, spec: PanelSpec = DEFAULT, ratios=None, seed=None,
                   materialize_input: bool = True) -> DataFrame:
    """SPL1 + JN1 at episode level: membership on the distinct entities, then a
    row-local split label from the broadcast one-row cut keys.  The episode
    table feeds both, so it is checkpointed once first (see ``materialize``), and the
    cut keys, one row, are found once however many passes read the labels."""
    kw = {k: v for k, v in (("ratios", ratios), ("seed", seed)) if v is not None}
    require_stage(ep, spec)  # DQ18
    if materialize_input:
        ep = materialize(ep)
    membership = split_membership(ep, spec, **kw)
    return assign_split(ep, materialize(split_cuts(membership, spec)), spec, **({"seed": seed} if seed else {}))


def split_daily(episodes: DataFrame, spec: PanelSpec = DEFAULT, ratios=None, seed=None) -> DataFrame:
    """Unscaled daily panel with its ``split`` label, split decided per episode
    (one hash per episode, not per day) before the explode."""
    return expand_days(split_episodes(spread(prepared_episodes(episodes, spec), episodes, spec), spec, ratios, seed), spec)


def fit_scaler_on_episodes(ep_split: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """SCL1 without exploding: on the daily panel every scaled column except the
    day is constant within an episode and the day runs 0 .. length-1, so the
    train min/max over days equal those over two rows per episode."""
    ends = ep_split.withColumn(spec.day, F.explode(F.array(F.lit(0), F.col(spec.length) - 1)))
    return fit_minmax(ends, spec.scale_columns, spec, fit_filter=F.col("split") == "train")


def split_and_scale(episodes: DataFrame, spec: PanelSpec = DEFAULT, ratios=None, seed=None):
    """Entry B, first half, as one plan: split and scale episode-constant columns on
    the episode table, explode, then scale the day (raw day kept as ``<day>_raw``).
    Returns (scaled daily panel with ``split``, one-row scaler parameters)."""
    ep, params = scaled_episodes(episodes, spec, ratios, seed)
    return scaled_days(ep, params, spec), params


def scaled_days(ep: DataFrame, params: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """The days of :func:`scaled_episodes`, the day scaled too."""
    return apply_minmax(expand_days(ep, spec), params, [spec.day], spec, keep_raw=(spec.day,))


def scaled_episodes(episodes: DataFrame, spec: PanelSpec = DEFAULT, ratios=None, seed=None):
    """Split, scaled episode table (day not yet expanded) and the scaler parameters (one row, found once)."""
    ep = split_episodes(spread(prepared_episodes(episodes, spec), episodes, spec), spec, ratios, seed)
    params = materialize(fit_scaler_on_episodes(ep, spec))
    static = [c for c in spec.scale_columns if c != spec.day]
    return apply_minmax(ep, params, static, spec), params


def countdown_moments(ep: DataFrame, params: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Two rows per scaled episode, ``weight`` half its days each, with the sums of every product of two of (1, features,
    countdown) that its days have: over days 0 .. n-1 the other features are constant, the countdown falls by one a day,
    and (n-1)/2 -+ sqrt((n^2-1)/12) have the mean and mean square of the days. A least-squares fit reads nothing else."""
    n = F.col(spec.length).cast("double")
    far = F.sqrt((n * n - 1.0) / 12.0)
    day = F.explode(F.array((n - 1.0) / 2.0 - far, (n - 1.0) / 2.0 + far))
    rows = ep.withColumn(spec.day, day).withColumns({
        spec.countdown: F.datediff(F.col(spec.next_start), F.col(spec.start)) - F.col(spec.day), "weight": n / 2.0})
    return apply_minmax(rows, params, [spec.day], spec)


def window_source(episodes: DataFrame, spec: PanelSpec = DEFAULT, features=None, ratios=None,
                  seed=None) -> DataFrame:
    """Entry B, second half: the per-episode sorted day rows of the split, scaled
    panel, built directly from each episode row (GEN1 fused into GEN2).

    The rows are the same as ``episode_rows(split_and_scale(...)[0])`` (tested),
    but come without exploding, shuffling and re-collecting the daily panel.
    """
    ep, params = scaled_episodes(episodes, spec, ratios, seed)
    feats = list(spec.input_features if features is None else features)
    return episode_rows_direct(ep, params, feats, spec)
