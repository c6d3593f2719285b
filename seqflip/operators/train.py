"""Split, train, evaluate.

Training data is never collected: every fit is an aggregation (count weights)
or an MLlib estimator over the distributed table.  What reaches the driver is
the fitted model, whose size is fixed by ``L x K`` (and the layer sizes).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import split_name
from ..spec import MICRO, SequenceSpec
from .model import LinearModel
from .score import linear_logit


# --- T1 / T2 ------------------------------------------------------------------

def split_dataset(df: DataFrame, key: str, spec: SequenceSpec = SequenceSpec(), col: str = "split") -> DataFrame:
    """80/10/10 split from a hash of ``(seed, key)`` - stable under any partitioning."""
    return df.withColumn(col, split_name(spec.seed, F.col(key)))


def split_counts(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Rows per split and label."""
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))


# --- T4: closed-form count weights -------------------------------------------

def count_weight_table(train: DataFrame, spec: SequenceSpec = SequenceSpec(), tokens: str = "tokens",
                       label: str = "label") -> DataFrame:
    """Smoothed log ratios per ``(pos, token)`` in integer micro-logits::

        w    = round(1e6 * (ln((n1 + 1) / (t1 + K)) - ln((n0 + 1) / (t0 + K))))
        bias = round(1e6 * ln(t1 / t0))

    ``n1, n0``: class counts of the cell; ``t1, t0``: sequences per class.  The
    scan explodes positions inside the map stage and pre-aggregates there, so
    the shuffle carries at most ``2*L*K`` partial rows per task whatever the
    skew.  Every one of the ``L*K`` cells is present (absent cells count 0)."""
    L, K = spec.length, spec.alphabet
    spark = train.sparkSession
    # The outer form keeps the optimiser from inferring a non-empty filter on the
    # array and pushing it (with the whole array expression) below the projection.
    counts = (train.select(F.col(label).alias("_y"), F.posexplode_outer(tokens).alias("pos", "token"))
              .where(F.col("pos").isNotNull())
              .groupBy("pos", "token")
              .agg(F.count_if(F.col("_y") == 1).alias("n1"), F.count_if(F.col("_y") == 0).alias("n0")))
    grid = spark.range(L * K).select((F.col("id") / K).cast("int").alias("pos"), (F.col("id") % K).cast("int").alias("token"))
    # Both sides hold at most L*K rows (a bound fixed by the sequence shape).
    cells = grid.join(F.broadcast(counts), ["pos", "token"], "left").fillna(0, ["n1", "n0"])
    by_pos = Window.partitionBy("pos")
    cells = (cells.withColumn("t1", F.sum("n1").over(by_pos)).withColumn("t0", F.sum("n0").over(by_pos)))
    ln = F.log
    w = F.round(MICRO * (ln((F.col("n1") + 1) / (F.col("t1") + K)) - ln((F.col("n0") + 1) / (F.col("t0") + K))))
    bias = F.round(MICRO * ln(F.col("t1") / F.col("t0")))
    return cells.select("pos", "token", w.cast("bigint").alias("w"), "n1", "n0", "t1", "t0",
                        F.when((F.col("t1") > 0) & (F.col("t0") > 0), bias.cast("bigint")).alias("bias"))


def train_count_weights(train: DataFrame, spec: SequenceSpec = SequenceSpec(), tokens: str = "tokens",
                        label: str = "label") -> LinearModel:
    """T4: fit the count-weight model (one aggregation job, ``L*K`` rows to the driver)."""
    L, K = spec.length, spec.alphabet
    rows = count_weight_table(train, spec, tokens, label).collect()
    if not rows or rows[0]["t1"] == 0 or rows[0]["t0"] == 0:
        raise ValueError("training data needs sequences of both classes")
    flat = [0] * (L * K)
    for r in rows:
        flat[r["pos"] * K + r["token"]] = int(r["w"])
    return LinearModel(L, K, tuple(flat), int(rows[0]["bias"]), integer=True)


# --- T6 ----------------------------------------------------------------------------

def predict_label(z, integer: bool = True):
    """Class 1 iff score > 0.5, i.e. logit > 0."""
    return (z > 0).cast("int")


def accuracy_by_split(df: DataFrame, model: LinearModel, split: str = "split", label: str = "label",
                      tokens: str = "tokens") -> DataFrame:
    """``(split, n, accuracy)``."""
    pred = predict_label(linear_logit(tokens, model))
    return (df.select(split, F.col(label).alias("_y"), pred.alias("_p"))
            .groupBy(split).agg(F.count(F.lit(1)).alias("n"),
                                F.avg((F.col("_y") == F.col("_p")).cast("double")).alias("accuracy")))


# --- MLlib features ------------------------------------------------------------

def one_hot_features(df: DataFrame, spec: SequenceSpec, tokens: str = "tokens", out: str = "features") -> DataFrame:
    """Sparse one-hot vector of size ``L*K`` with index ``pos*K + token`` (JVM-side:
    a fixed-vocabulary ``CountVectorizerModel`` over the cell ids)."""
    from pyspark.ml.feature import CountVectorizerModel

    L, K = spec.length, spec.alphabet
    cv = CountVectorizerModel.from_vocabulary([str(i) for i in range(L * K)], inputCol="_cells",
                                              outputCol=out, binary=True)
    cells = df.withColumn("_cells", F.transform(tokens, lambda t, i: (i * K + t).cast("string")))
    return cv.transform(cells).drop("_cells")


# --- T3: logistic regression ------------------------------------------------------

@dataclass(frozen=True)
class FitReport:
    """How a solver stopped: ``converged`` is false if it used up its iterations."""
    iterations: int
    max_iter: int
    objective: float

    @property
    def converged(self) -> bool:
        return self.iterations < self.max_iter

    @property
    def stopped(self) -> str:
        return "converged" if self.converged else "max_iter"


def _report(fitted, max_iter: int) -> FitReport:
    summary = fitted.summary() if callable(fitted.summary) else fitted.summary
    return FitReport(int(summary.totalIterations), max_iter, float(summary.objectiveHistory[-1]))


def fit_logistic(train: DataFrame, spec: SequenceSpec = SequenceSpec(), tokens: str = "tokens", label: str = "label",
                 max_iter: int = 100, reg_param: float = 0.0, tol: float = 1e-6) -> tuple[LinearModel, FitReport]:
    """Logistic regression on the one-hot input -> float ``LinearModel``, and how its solver stopped: MLlib's objective and
    solver, over packed cells (see :mod:`.logistic`).  Rows of one class, or none, are left to MLlib itself."""
    from pyspark.ml.classification import LogisticRegression

    from .logistic import fitted_logistic

    L, K = spec.length, spec.alphabet
    found = fitted_logistic(train, spec, tokens, label, max_iter, reg_param, tol)
    if found is not None:
        weights, intercept, objective, iterations = found
        return LinearModel(L, K, tuple(float(x) for x in weights), intercept, integer=False), FitReport(iterations, max_iter, objective)
    data = one_hot_features(train.select(tokens, F.col(label).cast("double").alias("label")), spec, tokens)
    lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=reg_param, tol=tol,
                            standardization=False, family="binomial")
    fitted = lr.fit(data)
    coef = fitted.coefficients.toArray()
    return LinearModel(L, K, tuple(float(x) for x in coef), float(fitted.intercept), integer=False), _report(fitted, max_iter)


def train_logistic(train: DataFrame, spec: SequenceSpec = SequenceSpec(), tokens: str = "tokens",
                   label: str = "label", max_iter: int = 100, reg_param: float = 0.0) -> LinearModel:
    """The model of :func:`fit_logistic`."""
    return fit_logistic(train, spec, tokens, label, max_iter, reg_param)[0]


# --- T5: multilayer perceptron ------------------------------------------------------

@dataclass(frozen=True)
class MLPModel:
    """Dense feed-forward model: sigmoid hidden layers, softmax output (2 classes)."""
    length: int
    alphabet: int
    layers: tuple
    weights: tuple   # per layer: (in x out) matrix then out biases, as MLlib lays them out

    def matrices(self) -> list[tuple[np.ndarray, np.ndarray]]:
        flat = np.asarray(self.weights, dtype=np.float64)
        out, off = [], 0
        for n_in, n_out in zip(self.layers[:-1], self.layers[1:]):
            W = flat[off:off + n_in * n_out].reshape(n_in, n_out)
            off += n_in * n_out
            b = flat[off:off + n_out]
            off += n_out
            out.append((W, b))
        return out


def fit_mlp(train: DataFrame, spec: SequenceSpec = SequenceSpec(), hidden: Sequence[int] = (32, 16), tokens: str = "tokens",
            label: str = "label", max_iter: int = 100, seed: int | None = None) -> tuple[MLPModel, FitReport]:
    """T5: multilayer perceptron on the one-hot input (layers ``[L*K, *hidden, 2]``): MLlib's starting weights, objective and
    solver, over packed cells (see :mod:`.perceptron`); and how its solver stopped."""
    from .perceptron import fitted_weights

    L, K = spec.length, spec.alphabet
    layers = [L * K, *hidden, 2]
    weights, objective, iterations = fitted_weights(train, spec, layers, tokens, label, max_iter, spec.seed if seed is None else seed)
    return MLPModel(L, K, tuple(layers), tuple(float(x) for x in weights)), FitReport(iterations, max_iter, objective)


def train_mlp(train: DataFrame, spec: SequenceSpec = SequenceSpec(), hidden: Sequence[int] = (32, 16),
              tokens: str = "tokens", label: str = "label", max_iter: int = 100, seed: int | None = None) -> MLPModel:
    """T5: the model of :func:`fit_mlp`."""
    return fit_mlp(train, spec, hidden, tokens, label, max_iter, seed)[0]


def train_model(train: DataFrame, model_type: str, spec: SequenceSpec = SequenceSpec(), **kw):
    """T7 model slot chosen by name: ``count`` (closed form), ``lr`` (MLlib), ``mlp`` (MLlib)."""
    kind = model_type.lower()
    if kind in ("count", "counts"):
        return train_count_weights(train, spec, **kw)
    if kind in ("lr", "logistic"):
        return train_logistic(train, spec, **kw)
    if kind in ("mlp", "nonlinear"):
        return train_mlp(train, spec, **kw)
    raise ValueError(f"unknown model type {model_type!r}")
