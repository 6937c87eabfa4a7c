"""FCT1-FCT5: forecasts that feed the evaluation operators.

FCT1 is a deterministic, leakage-free baseline built only from the history
features; FCT2-FCT4 re-aim the reference's two heads as distributed
``pyspark.ml`` estimators (fit on train rows, score all rows); FCT5 scores
any caller-supplied model batch-wise with Arrow (``mapInPandas``). The recurrent
per-timestep model is in :mod:`panelspark.operators.training`, stored models
are in :mod:`panelspark.sources.models`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import DEFAULT, PanelSpec
from .expand import phase_label


def history_forecast(daily: DataFrame, spec: PanelSpec = DEFAULT, confidence: float = 0.85) -> DataFrame:
    """FCT1: countdown = max(history mean length - day, 0); phase from the phase rule
    with the rounded history means; probabilities put ``confidence`` on that phase."""
    day = F.col(spec.day)
    cyc = F.rint(F.col(spec.hist_length)).cast("int")
    pre = F.rint(F.col(spec.hist_prefix)).cast("int")
    lab = phase_label(day, cyc, pre, spec.ovulation_offset)
    other = (1.0 - confidence) / (len(spec.labels) - 1)
    probs = F.transform(F.array(*[F.lit(k) for k in spec.labels]),
                        lambda k: F.when(k == lab, F.lit(confidence)).otherwise(F.lit(other)))
    return daily.withColumns({
        "pred_label": lab,
        "pred_reg": F.greatest(F.col(spec.hist_length) - day, F.lit(0.0)),
        "probs": probs,
    })


def _assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def fit_phase_classifier(scaled: DataFrame, features=None, spec: PanelSpec = DEFAULT, max_iter: int = 25):
    """FCT2: multinomial logistic regression on the daily features, fit on train rows."""
    from pyspark.ml.classification import LogisticRegression
    features = list(features or spec.input_features)
    train = _assemble(scaled.filter(F.col("split") == "train"), features)
    lr = LogisticRegression(featuresCol="features", labelCol=spec.label, family="multinomial",
                            maxIter=max_iter, regParam=1e-4)
    return lr.fit(train)


def _checked(features, margin, value, kind: str):
    """The value; a null or NaN among the features fails the job, as in the fit. Either makes the ``margin`` null or NaN, so
    the features are looked at only where it is."""
    bad = F.lit(False)
    for c in features:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    bad = (margin.isNull() | F.isnan(margin)) & bad
    return F.when(bad, F.raise_error(F.lit("a feature of a row to be scored is null or NaN")).cast(kind)).otherwise(value)


def _once(df: DataFrame, name: str, fields: dict) -> DataFrame:
    """A struct column whose fields are worked out once per row: the explode keeps what reads them from working them out again."""
    return df.withColumn(name, F.explode(F.array(F.struct(*[v.alias(k) for k, v in fields.items()]))))


def _dot(features, coef):
    out = None
    for c, w in zip(features, coef, strict=True):
        term = F.col(c).cast("double") * F.lit(float(w))
        out = term if out is None else out + term
    return out


def score_phase_classifier(model, scaled: DataFrame, features=None, spec: PanelSpec = DEFAULT) -> DataFrame:
    """``probs`` and ``pred_label`` of the fitted model as columns: no vector is built per row, and margins and their
    exponentials are worked out once. The first class of the largest margin is the label."""
    features = list(features or spec.input_features)
    coef, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    k = range(len(b))
    out = _once(scaled, "__z", {f"z{i}": _dot(features, coef[i]) + F.lit(float(b[i])) for i in k})
    z = [F.col("__z")[f"z{i}"] for i in k]
    top = F.greatest(*z)
    label = F.lit(len(z) - 1)
    for i in range(len(z) - 2, -1, -1):
        label = F.when(z[i] == top, F.lit(i)).otherwise(label)
    out = out.withColumn("pred_label", _checked(features, z[0], label, "int"))
    out = _once(out, "__e", {f"e{i}": F.exp(z[i] - top) for i in k})
    e = [F.col("__e")[f"e{i}"] for i in k]
    probs = F.array(*[x / sum(e[1:], e[0]) for x in e])
    return out.withColumn("probs", _checked(features, z[0], probs, "array<double>")).drop("__z", "__e")


def fit_countdown_regressor(scaled: DataFrame, features=None, spec: PanelSpec = DEFAULT, max_iter: int = 25,
                            weight: str | None = None):
    """FCT3: linear regression of the countdown on the daily features (train rows). With few features it is solved
    from sums of products, so rows of :func:`panelspark.plans.pipelines.countdown_moments` with their ``weight`` give the
    model of all their days."""
    from pyspark.ml.regression import LinearRegression
    features = list(features or spec.input_features)
    train = _assemble(scaled.filter(F.col("split") == "train"), features)
    lr = LinearRegression(featuresCol="features", labelCol=spec.countdown, maxIter=max_iter, regParam=1e-4)
    return (lr.setWeightCol(weight) if weight else lr).fit(train)


def score_countdown_regressor(model, scaled: DataFrame, features=None, spec: PanelSpec = DEFAULT) -> DataFrame:
    features = list(features or spec.input_features)
    pred = _dot(features, model.coefficients.toArray()) + F.lit(float(model.intercept))
    out = _once(scaled, "__z", {"z": pred})
    z = F.col("__z")["z"]
    return out.withColumn("pred_reg", _checked(features, z, z, "double")).drop("__z")


def flatten_window_features(w: DataFrame) -> DataFrame:
    """FCT4 input: a window's L x F matrix as one L*F vector; targets of the last day."""
    from pyspark.ml.functions import array_to_vector
    return w.withColumns({
        "features": array_to_vector(F.flatten(F.col("win.x"))),
        "y_last": F.element_at("win", -1)["y"],
        "r_last": F.element_at("win", -1)["r"].cast("double"),
    }).drop("win")


def fit_window_models(flat: DataFrame, max_iter: int = 10):
    """FCT4: phase and countdown of the window's last day from the whole window."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import LinearRegression
    train = flat.filter(F.col("split") == "train")
    clf = LogisticRegression(labelCol="y_last", family="multinomial", maxIter=max_iter, regParam=1e-4).fit(train)
    reg = LinearRegression(labelCol="r_last", maxIter=max_iter, regParam=1e-4).fit(train)
    return clf, reg


def score_batches(df: DataFrame, features, predict: Callable, out_schema: str, keep=()) -> DataFrame:
    """FCT5: distributed batch scoring of a caller-supplied model.

    ``predict(pandas.DataFrame of features)`` runs once per Arrow batch inside the executors and returns a
    pandas.DataFrame, or a dict of numpy arrays (one of two dimensions is a column of arrays); ``keep`` columns are
    passed through as they came, never as Python values.
    """
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    features, keep = list(features), list(keep)
    schema = to_arrow_schema(StructType.fromDDL(out_schema))

    def column(values, kind):
        if getattr(values, "ndim", 1) == 1:
            return pa.Array.from_pandas(values, type=kind)
        ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * np.int32(values.shape[1]))
        return pa.ListArray.from_arrays(ends, pa.array(values.ravel(), from_pandas=True)).cast(kind)

    def frame(batch):
        """The features as a frame on one block of memory, where they are doubles without nulls."""
        if not all(pa.types.is_float64(batch.column(c).type) and not batch.column(c).null_count for c in features):
            return batch.select(features).to_pandas()
        block = np.empty((len(features), batch.num_rows))
        for i, c in enumerate(features):
            block[i] = batch.column(c).to_numpy()
        return pd.DataFrame(block.T, columns=features, copy=False)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                res = predict(frame(batch))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(f.name).cast(f.type) if f.name in keep else column(res[f.name], f.type) for f in schema],
                    names=schema.names)

    return df.select(*keep, *[f for f in features if f not in keep]).mapInArrow(run, out_schema)


def softmax_predictor(coef, intercept) -> Callable:
    """A numpy multinomial model as a ``predict`` function for :func:`score_batches`."""
    import numpy as np
    import pandas as pd

    W = np.asarray(coef, dtype="float64")
    b = np.asarray(intercept, dtype="float64")

    def predict(x: pd.DataFrame) -> dict:
        z = W @ x.to_numpy(dtype="float64").T + b[:, None]  # a class per row: sums and maxima run along memory
        z -= z.max(axis=0)
        p = np.exp(z, out=z)
        p /= p.sum(axis=0)
        return {"pred_label": p.argmax(axis=0).astype("int32"), "probs": np.ascontiguousarray(p.T)}

    return predict
