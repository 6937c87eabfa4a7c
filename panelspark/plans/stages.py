"""Entry points A and B with their checks enforced. Each stage is written, audited and only then published
(:mod:`panelspark.sources.store`): a rule of level "error" raises :class:`DataQualityError`, nothing is published, and
the version published before stays as it was. Warnings go into the manifest with all other results.

Rules that look at one row at a time are counted while the rows are written; a stage is read again at most once,
for the rules that need its rows grouped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, scale, sequences, split
from ..operators.clean import drop_bad_dates, parse_dates
from ..operators.expand import expand_days
from ..session import materialize
from ..sources import io
from ..sources.store import Draft, StageStore, publishing
from ..spec import DEFAULT, SPLIT_RATIOS, SPLIT_SEED, PanelSpec
from .pipelines import day_partitions, prepared_episodes


def _audit(draft: Draft, rows: list[tuple[str, str, int]]) -> None:
    draft.record(rows)
    quality.enforce_results(rows)


def build_daily(raw: DataFrame, path: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Entry A: clean, history, encodings -> table ``episodes``, checked (DQ1, DQ8, DQ10, null keys); days -> table
    ``daily``, checked (DQ4-DQ6, which also finds repeated episodes). Returns the published daily panel."""
    with publishing(raw.sparkSession, path) as draft:
        _daily_tables(draft, raw, spec)
    return io.read_daily(raw.sparkSession, draft.path("daily"))


def _daily_tables(draft: Draft, raw: DataFrame, spec: PanelSpec) -> None:
    spark = raw.sparkSession
    clean = drop_bad_dates(parse_dates(raw, spec), spec)
    checks = quality.episode_checks(spec) + quality.encoding_checks(spec) + quality.history_flag_checks(spec)
    ep = quality.Watched(prepared_episodes(clean, spec), checks, days=F.sum(F.col(spec.length).cast("long")))
    ep.rows.write.parquet(draft.path("episodes"))
    _audit(draft, ep.results())
    stored = spark.read.parquet(draft.path("episodes"))
    days = ep.measured("days") or 0
    ranged = stored.repartitionByRange(day_partitions(days, spark), spec.entity, spec.start)
    io.write_daily(expand_days(ranged, spec), draft.path("daily"), spec)
    daily = io.read_daily(spark, draft.path("daily"))
    _audit(draft, quality.results_of(quality.daily_report(daily, days, spec)))


def build_daily_from_csv(spark: SparkSession, csv: str, path: str, spec: PanelSpec = DEFAULT, max_rejected: float = 0.05) -> DataFrame:
    """Entry A from its file: SRC1 with the reject channel, then as :func:`build_daily`. Rows with a cell that can't be
    read go to the table ``rejects``; more than a share of ``max_rejected`` of them is an error. Read = kept + rejected
    is counted on the way and stands in the manifest."""
    with publishing(spark, path) as draft:
        typed = io.typed_episodes(spark, csv, spec)
        seen = quality.Watched(typed, [("rows_read", "info", F.count(F.lit(1))),
                                       ("rows_rejected", "info", F.count_if(F.size(io.BAD_CELLS) > 0))])
        seen.rows.write.parquet(draft.path("typed"))
        stored = spark.read.parquet(draft.path("typed"))
        io.rejects(stored).write.parquet(draft.path("rejects"))
        (_, _, read), (_, _, bad) = rows = seen.results()
        _audit(draft, [*rows, ("too_many_rejects", "error", bad if bad > max_rejected * read else 0)])
        draft.notes["rows"] = {"read": read, "kept": read - bad, "rejected": bad}
        _daily_tables(draft, io.accepted(stored), spec)
    return io.read_daily(spark, draft.path("daily"))


def build_splits(daily: DataFrame, path: str, spec: PanelSpec = DEFAULT, ratios=SPLIT_RATIOS,
                 seed: int = SPLIT_SEED) -> DataFrame:
    """Entry B, first half, on a stored daily panel (DQ18, DQ19): split by entity, scale with train statistics ->
    tables ``membership``, ``scaler``, ``splits``; checked (DQ13-DQ15). The raw day stays as
    ``<day>_raw``. Values of val and test outside 0..1 are no error (DQ12)."""
    spark = daily.sparkSession
    quality.require_stage(daily, spec)
    with publishing(spark, path) as draft:
        membership = materialize(split.split_membership(daily, spec, ratios, seed))
        io.write_membership(membership, draft.path("membership"), ratios, seed, spec=spec)
        panel = split.assign_split(daily, split.split_cuts(membership, spec), spec, seed)
        io.write_scaler(scale.fit_minmax(panel, spec=spec, fit_filter=F.col("split") == "train"), draft.path("scaler"))
        params = spark.read.parquet(draft.path("scaler"))
        scaled = scale.apply_minmax(panel, params, spec=spec, keep_raw=(spec.day,))
        seen = quality.Watched(scaled, range_checks(scaled, spec))
        io.write_splits(seen.rows, draft.path("splits"))
        out = io.read_splits(spark, draft.path("splits"))
        _audit(draft, quality.results_of(split_rules(out, spec)))
        _audit(draft, seen.results())
    return out


def split_rules(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """DQ15: an entity in two splits is an error."""
    pairs = split.split_overlap(panel, spec).filter(F.col("pair") != "covered")
    return pairs.select(F.concat(F.lit("overlap_"), "pair").alias("check"), F.lit("error").alias("severity"),
                        F.col("n_entities").alias("violations"))


def range_checks(panel: DataFrame, spec: PanelSpec = DEFAULT) -> quality.Checks:
    """DQ12-DQ14 per split as checks; only cells out of range are a warning."""
    return [(f"{rule}_{s}", "warn" if rule == "n_out_of_range" else "error", F.sum(F.when(F.col("split") == s, cells)))
            for rule, cells in scale.range_counts(panel.columns, spec=spec).items() for s in split.SPLITS]


def build_windows(panel: DataFrame, path: str, lengths, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Entry B, second half, on a stored split panel (PRJ15, PRJ16): windows -> table ``windows``, their shapes ->
    ``metadata``; checked (DQ16, DQ17). Returns the metadata."""
    spark = panel.sparkSession
    lengths = [lengths] if isinstance(lengths, int) else list(lengths)
    sequences.require_features(panel, spec=spec)
    raw_day = f"{spec.day}_raw"
    rows = sequences.episode_rows(panel, spec=spec, order_col=raw_day if raw_day in panel.columns else None)
    cells = [(n, s) for n in lengths for s in split.SPLITS]
    with publishing(spark, path) as draft:
        due = {f"due_{n}_{s}": F.sum(F.when(F.col("split") == s, F.greatest(F.size("rows") - n + 1, F.lit(0))).otherwise(0))
               for n, s in cells}
        episodes = quality.Watched(rows, [], **due)
        w = sequences.window_arrays(sequences.windows(episodes.rows, lengths))
        checks = [(f"{name}_{n}", severity, e) for n in lengths
                  for name, severity, e in quality.window_checks(n, len(spec.input_features), F.col("seq_length") == n, spec)]
        here = {(n, s): (F.col("seq_length") == n) & (F.col("split") == s) for n, s in cells}
        seen = quality.Watched(w, [*checks, ("unknown_split", "error", F.count_if(~F.coalesce(F.col("split").isin(*split.SPLITS), F.lit(False))))],
                               **{f"n_{n}_{s}": F.count_if(c) for (n, s), c in here.items()},
                               **{f"width_{n}_{s}": F.max(F.when(c, F.size(F.col("X")[0]))) for (n, s), c in here.items()})
        io.write_windows(seen.rows, draft.path("windows"))
        _audit(draft, seen.results())
        _audit(draft, [(f"windows_{s}_{n}", "error", abs((episodes.measured(f"due_{n}_{s}") or 0) - seen.measured(f"n_{n}_{s}")))
                       for n, s in cells])
        meta = [(s, n, seen.measured(f"n_{n}_{s}"), seen.measured(f"width_{n}_{s}"), [spec.label, spec.countdown])
                for n, s in cells if seen.measured(f"n_{n}_{s}")]
        io.write_window_metadata(spark.createDataFrame(
            meta, "split string, seq_length int, n_windows long, n_features int, targets array<string>"), draft.path("metadata"))
    return spark.read.json(draft.path("metadata"))


def published(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A published table of any stage above."""
    return StageStore(spark, path).read(table)
