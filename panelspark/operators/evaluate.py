"""EVL1-EVL10: scoring a prediction table.

A prediction table has a true label ``y``, a predicted label ``yhat`` (or a
probability array), a true and a predicted regression value, optional group
columns (e.g. ``split``) and an optional weight ``w``: the number of
overlapping windows a daily row appears in reproduces the reference's
per-timestep metrics without materialising windows (T12); ``w = 1`` gives
per-distinct-day metrics.  Everything reduces to sums per (group, y, yhat),
so the only shuffle is a tiny aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import first_argmax
from ..spec import DEFAULT, LOG_CLIP, LOSS_WEIGHTS, PHASE_NAMES

LABELS = DEFAULT.labels


def argmax_label(probs) -> F.Column:
    """EVL1: first index of the maximum probability."""
    return first_argmax(probs)


def _w(df: DataFrame, weight: str | None):
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def prediction_cube(df: DataFrame, y: str, yhat: str, groups=(), weight: str | None = None,
                    y_reg: str | None = None, pred_reg: str | None = None, probs: str | None = None,
                    clip: float = LOG_CLIP) -> DataFrame:
    """One pass over the predictions: per (groups, true_label, pred_label) the
    weight sum and, when given, weighted sums of |e|, e^2 and -ln p_true.  Every
    metric below derives from this table of at most groups x 16 rows."""
    w = _w(df, weight)
    aggs = [F.sum(w).alias("n")]
    if y_reg is not None:
        e = F.col(pred_reg).cast("double") - F.col(y_reg).cast("double")
        aggs += [F.sum(w * F.abs(e)).alias("sae"), F.sum(w * e * e).alias("sse")]
    if probs is not None:
        p_true = F.element_at(F.col(probs), F.col(y).cast("int") + 1)
        ce = -F.log(F.greatest(F.least(p_true, F.lit(1.0 - clip)), F.lit(clip)))
        aggs.append(F.sum(w * ce).alias("sce"))
    return df.groupBy(*groups, F.col(y).cast("int").alias("true_label"),
                      F.col(yhat).cast("int").alias("pred_label")).agg(*aggs)


def confusion_from_cube(cube: DataFrame, groups=(), labels=LABELS) -> DataFrame:
    """EVL3: (groups, true_label, pred_label, n) for every label pair, empty cells 0. The cube is read once: the
    pairs are added to its cells as zeros."""
    zeros = [F.struct(F.lit(int(a)).alias("true_label"), F.lit(int(b)).alias("pred_label"), F.lit(0.0).alias("n"))
             for a in labels for b in labels]
    cells = F.explode(F.array(F.struct("true_label", "pred_label", F.col("n").cast("double").alias("n")), *zeros))
    return cube.select(*groups, cells.alias("c")).select(*groups, "c.*") \
        .filter(F.col("true_label").isin(list(labels)) & F.col("pred_label").isin(list(labels))) \
        .groupBy(*groups, "true_label", "pred_label").agg(F.sum("n").alias("n"))


def confusion_long(df: DataFrame, y: str, yhat: str, groups=(), weight: str | None = None,
                   labels=LABELS) -> DataFrame:
    """EVL3 straight from a prediction table."""
    return confusion_from_cube(prediction_cube(df, y, yhat, groups, weight), groups, labels)


def confusion_matrix(conf_long: DataFrame, groups=(), labels=LABELS) -> DataFrame:
    """EVL3 wide: rows = true label, one column per predicted label."""
    return conf_long.groupBy(*groups, "true_label").pivot("pred_label", list(labels)).agg(F.sum("n")) \
        .fillna(0.0)


def class_report(conf_long: DataFrame, groups=(), names=PHASE_NAMES, carry=()) -> DataFrame:
    """EVL4: per class precision, recall, F1 and support; a zero denominator gives 0. Each cell counts for the
    support of its true label and the predictions of its predicted one, in one pass. Columns in ``carry`` are
    summed under the true label."""
    groups = list(groups)
    hit = F.col("true_label") == F.col("pred_label")
    z = F.lit(0.0)
    as_true = F.struct(F.col("true_label").alias("label"), F.col("n").alias("support"), z.alias("predicted"),
                       F.when(hit, F.col("n")).otherwise(z).alias("tp"), *[F.col(c) for c in carry])
    as_pred = F.struct(F.col("pred_label").alias("label"), z.alias("support"), F.col("n").alias("predicted"),
                       z.alias("tp"), *[z.alias(c) for c in carry])
    sums = conf_long.select(*groups, F.explode(F.array(as_true, as_pred)).alias("c")).select(*groups, "c.*") \
        .groupBy(*groups, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp", *carry)])
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("label") + 1)
    return sums.select(*groups, "label", name.alias("class_name"),
                       F.coalesce(F.try_divide("tp", "predicted"), z).alias("precision"),
                       F.coalesce(F.try_divide("tp", "support"), z).alias("recall"),
                       F.coalesce(F.try_divide(F.col("tp") * 2.0, F.col("support") + F.col("predicted")), z)
                       .alias("f1"),
                       "support", "predicted", "tp", *carry)


def summary_scores(report: DataFrame, groups=()) -> DataFrame:
    """EVL2 + EVL5: accuracy, macro F1 and support-weighted F1 over the classes present
    in the truth or the prediction (labels with neither are left out, like sklearn)."""
    present = (F.col("support") + F.col("predicted")) > 0
    return report.groupBy(*groups).agg(
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(present, F.col("f1"))).alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


def regression_error(df: DataFrame, y: str, pred: str, groups=(), weight: str | None = None) -> DataFrame:
    """EVL6: MAE and RMSE."""
    w = _w(df, weight)
    e = F.col(pred).cast("double") - F.col(y).cast("double")
    g = df.groupBy(*groups).agg(F.sum(w).alias("__sw"), F.sum(w * F.abs(e)).alias("__a"),
                                F.sum(w * e * e).alias("__s"))
    return g.select(*groups, F.try_divide("__a", "__sw").alias("mae"),
                    F.sqrt(F.try_divide("__s", "__sw")).alias("rmse"))


def composite_loss(df: DataFrame, y: str, probs: str, y_reg: str, pred_reg: str, groups=(),
                   weight: str | None = None, weights=LOSS_WEIGHTS, clip: float = LOG_CLIP) -> DataFrame:
    """EVL7: w_cls * mean(-ln p_true) + w_reg * MAE, probabilities clipped at ``clip``."""
    w = _w(df, weight)
    p_true = F.element_at(F.col(probs), F.col(y).cast("int") + 1)
    ce = -F.log(F.greatest(F.least(p_true, F.lit(1.0 - clip)), F.lit(clip)))
    ae = F.abs(F.col(pred_reg).cast("double") - F.col(y_reg).cast("double"))
    g = df.groupBy(*groups).agg(F.sum(w).alias("__sw"), F.sum(w * ce).alias("__c"),
                                F.sum(w * ae).alias("__a"))
    ce_m, mae = F.try_divide("__c", "__sw"), F.try_divide("__a", "__sw")
    return g.select(*groups, ce_m.alias("cross_entropy"), mae.alias("mae"),
                    (F.lit(weights[0]) * ce_m + F.lit(weights[1]) * mae).alias("composite_loss"))


def errors_from_cube(cube: DataFrame, groups=(), weights=LOSS_WEIGHTS) -> DataFrame:
    """EVL6 + EVL7 from the cube: MAE, RMSE, cross-entropy and the composite loss."""
    g = cube.groupBy(*groups).agg(F.sum("n").alias("__sw"), F.sum("sae").alias("__a"),
                                  F.sum("sse").alias("__s"), F.sum("sce").alias("__c"))
    mae, ce = F.try_divide("__a", "__sw"), F.try_divide("__c", "__sw")
    return g.select(*groups, mae.alias("mae"), F.sqrt(F.try_divide("__s", "__sw")).alias("rmse"),
                    ce.alias("cross_entropy"),
                    (F.lit(weights[0]) * ce + F.lit(weights[1]) * mae).alias("composite_loss"))


def metrics_report(pred: DataFrame, groups=("split",), weight: str | None = None,
                   y="y_phase", yhat="pred_label", probs="probs", y_reg="y_reg",
                   pred_reg="pred_reg", digits: int = 9, names=PHASE_NAMES) -> DataFrame:
    """EVL8: long (groups, metric, class_name, value) report with every number above,
    from a single pass over the predictions (the cube). ``names`` are the classes in label order."""
    groups = list(groups)
    cube = prediction_cube(pred, y, yhat, groups, weight, y_reg, pred_reg, probs)
    errors = ["sae", "sse", "sce"]
    zeros = [F.struct(F.lit(a).alias("true_label"), F.lit(a).alias("pred_label"),
                      *[F.lit(0.0).alias(c) for c in ("n", *errors)]) for a in range(len(names))]  # every class gets its row
    cells = cube.select(*groups, F.explode(F.array(F.struct("true_label", "pred_label", "n", *errors), *zeros))
                        .alias("c")).select(*groups, "c.*")
    rep = class_report(cells, groups, names, carry=errors)
    present = (F.col("support") + F.col("predicted")) > 0
    total = F.sum("support")
    mae, ce = F.try_divide(F.sum("sae"), total), F.try_divide(F.sum("sce"), total)
    head = {"accuracy": F.try_divide(F.sum("tp"), total),
            "macro_f1": F.avg(F.when(present, F.col("f1"))),
            "weighted_f1": F.try_divide(F.sum(F.col("f1") * F.col("support")), total),
            "mae": mae, "rmse": F.sqrt(F.try_divide(F.sum("sse"), total)), "cross_entropy": ce,
            "composite_loss": F.lit(LOSS_WEIGHTS[0]) * ce + F.lit(LOSS_WEIGHTS[1]) * mae}
    per_class = ("precision", "recall", "f1", "support")
    wide = rep.groupBy(*groups).agg(*[v.alias(k) for k, v in head.items()],
                                    F.collect_list(F.struct("class_name", *per_class)).alias("classes"))  # one entry a class

    def line(metric, class_name, value):
        return F.struct(F.lit(metric).alias("metric"), value.alias("value"), class_name.alias("class_name"))

    top = F.array(*[line(m, F.lit(None).cast("string"), F.col(m)) for m in head])

    def lines(metric):
        return F.transform("classes", lambda c: line(metric, c["class_name"], c[metric]))

    return wide.select(*groups, F.explode(F.concat(top, *map(lines, per_class))).alias("r")).select(*groups, "r.*") \
        .withColumn("value", F.round("value", digits))


def metrics_nested(report_long: DataFrame, groups=("split",)) -> DataFrame:
    """The reference's nested report layout: one struct per group with the five
    headline numbers and a per-class map."""
    groups = list(groups)
    head = report_long.filter(F.col("class_name").isNull()).groupBy(*groups) \
        .pivot("metric", ["accuracy", "macro_f1", "weighted_f1", "mae", "rmse"]).agg(F.first("value"))
    head = head.withColumnsRenamed({"accuracy": "classification_accuracy", "mae": "regression_mae_days",
                                    "rmse": "regression_rmse_days"})
    per = report_long.filter(F.col("class_name").isNotNull()).groupBy(*groups, "class_name") \
        .pivot("metric", ["precision", "recall", "f1", "support"]).agg(F.first("value")) \
        .withColumnRenamed("f1", "f1-score")
    cls = per.groupBy(*groups).agg(F.map_from_entries(F.collect_list(
        F.struct("class_name", F.struct("precision", "recall", "f1-score", "support")))).alias(
        "classification_report"))
    return head.join(cls, groups)


# --- EVL9 / EVL10 / WIN7 on saved reports ------------------------------------

def leaderboard(reports: DataFrame, split: str = "test", by: str = "macro_f1") -> DataFrame:
    """EVL9: one row per saved experiment, best first; copes with old report layouts
    (``baseline_config`` instead of ``experiment_config``, ``optimizer`` vs
    ``optimizer_name``)."""
    cands = []
    for c in ("experiment_config", "baseline_config"):
        if c in reports.columns:
            fields = {f.name for f in reports.schema[c].dataType.fields}
            cands += [F.col(c)[o] for o in ("optimizer_name", "optimizer") if o in fields]
    opt = F.coalesce(*cands) if cands else F.lit(None).cast("string")
    sp = F.col(split)
    return reports.select(
        "experiment",
        opt.alias("optimizer"),
        sp["classification_accuracy"].alias("accuracy"), sp["macro_f1"].alias("macro_f1"),
        sp["weighted_f1"].alias("weighted_f1"), sp["regression_mae_days"].alias("mae_days"),
        sp["regression_rmse_days"].alias("rmse_days"),
    ).orderBy(F.col(by).desc(), "experiment")


# Keys of each curve in a training history, the first present wins (validation keys have "val_" before).
HISTORY_KEYS = {
    "loss": ("loss",),
    "phase_accuracy": ("phase_output_accuracy", "phase_output_acc", "accuracy", "acc"),
    "regression_mae": ("regression_output_mae", "regression_output_mean_absolute_error", "regression_mae", "mae"),
}


def history_long(history: DataFrame) -> DataFrame:
    """GEN6: a history row (experiment + one array per metric) -> (experiment, epoch, metric, value)."""
    metrics = [c for c in history.columns if c != "experiment"]
    parts = [history.select("experiment", F.lit(m).alias("metric"),
                            F.posexplode(F.col(m)).alias("epoch0", "value")) for m in metrics]
    u = reduce(DataFrame.unionByName, parts)
    return u.select("experiment", (F.col("epoch0") + 1).alias("epoch"), "metric", "value")


def learning_curves(hist_long: DataFrame) -> DataFrame:
    """EVL10: train vs validation value per (experiment, epoch, curve). The key of a curve is chosen for train and
    for validation on their own, so they may have different names."""
    rows = [(curve, rank, k) for curve, keys in HISTORY_KEYS.items() for rank, k in enumerate(keys)]
    fb = hist_long.sparkSession.createDataFrame(rows, "curve string, rank int, key string")
    h = hist_long.withColumn("phase", F.when(F.col("metric").startswith("val_"), "val").otherwise("train")) \
        .withColumn("key", F.regexp_replace("metric", "^val_", ""))
    j = h.join(F.broadcast(fb), "key")  # fallback table: a fixed handful of rows
    return j.groupBy("experiment", "curve", "epoch").agg(*[
        F.min_by(F.when(F.col("phase") == p, F.col("value")), F.when(F.col("phase") == p, F.col("rank"))).alias(p)
        for p in ("train", "val")])


def best_epoch(hist_long: DataFrame, metric: str = "val_loss") -> DataFrame:
    """WIN7: epoch of the minimum validation loss per run, and epochs run."""
    h = hist_long.filter(F.col("metric") == metric)
    return h.groupBy("experiment").agg(F.min_by("epoch", F.struct("value", "epoch")).alias("best_epoch"),
                                       F.min("value").alias("best_value"),
                                       F.max("epoch").alias("epochs_run"))
