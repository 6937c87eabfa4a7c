"""WIN1-WIN3: leakage-free history features from strictly earlier episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import round_half_even
from ..spec import DEFAULT, PanelSpec
from .prefix import exclusive_running


def tie_order(spec: PanelSpec = DEFAULT) -> list[str]:
    """Order of episodes of one entity: start, then an explicit tie-break (T6)."""
    if spec.arrival:
        return [spec.start, spec.arrival]
    return [spec.start, spec.next_start, spec.length, spec.prefix]


def add_history(df: DataFrame, spec: PanelSpec = DEFAULT, digits: int = 2) -> DataFrame:
    """Expanding mean of length and prefix length over earlier episodes (ROWS frame),
    cold-start flag *before* the fill, prior fill, then numpy-style rounding.

    Adds ``hist_mean_cycle``, ``hist_mean_period``, ``is_historical_data_missing``
    and ``n_prior_episodes`` (earlier rows of the entity; 0 = first episode).
    """
    r = exclusive_running(df, spec.entity, spec.start, tie_order(spec)[1:],
                          {"__hl": spec.length, "__hp": spec.prefix, "__n": F.lit(1)})
    mean_l = F.try_divide(F.col("__hl_sum"), F.col("__hl_cnt"))
    mean_p = F.try_divide(F.col("__hp_sum"), F.col("__hp_cnt"))
    r = r.withColumns({"__ml": mean_l, "__mp": mean_p,
                       "n_prior_episodes": F.coalesce(F.col("__n_sum"), F.lit(0)).cast("long")})
    return r.withColumns({
        spec.cold_flag: (F.col("__ml").isNull() | F.col("__mp").isNull()).cast("int"),
        spec.hist_length: round_half_even(F.coalesce("__ml", F.lit(spec.prior_length)), digits),
        spec.hist_prefix: round_half_even(F.coalesce("__mp", F.lit(spec.prior_prefix)), digits),
    }).drop("__hl_sum", "__hl_cnt", "__hp_sum", "__hp_cnt", "__n_sum", "__n_cnt",
                                   "__ml", "__mp")
