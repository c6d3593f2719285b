"""Models on disk (S5, S11): as parts of a bundle, as saved by MLlib, and fitted once per training table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.model import LinearModel
from ..operators.train import MLPModel
from ..session import ensure_checkpoint_dir
from ..spec import SequenceSpec
from .bundle import IncompleteBundle, read_bundle, table_digest, write_bundle

#: Optional session setting: the folder of fitted models; by default a folder of the application's checkpoint folder.
STORE_CONF = "spark.seqflip.modelStore"


# --- parts of a bundle --------------------------------------------------------------

def model_parts(spark: SparkSession, model: LinearModel | MLPModel) -> dict[str, DataFrame]:
    """``weights`` and ``meta`` of a model."""
    if isinstance(model, LinearModel):
        meta = [(model.length, model.alphabet, None, float(model.bias), model.integer)]
        weights = model.to_df(spark)
    else:
        meta = [(model.length, model.alphabet, list(model.layers), None, None)]
        weights = spark.createDataFrame(list(enumerate(model.weights)), "i INT, w DOUBLE")
    return {"weights": weights, "meta": spark.createDataFrame(meta, "length INT, alphabet INT, layers ARRAY<INT>, bias DOUBLE, integer BOOLEAN")}


def model_from_parts(parts: dict[str, DataFrame]) -> LinearModel | MLPModel:
    meta = parts["meta"].first()
    if meta["layers"] is None:
        return LinearModel.from_df(parts["weights"], meta["bias"], meta["length"], meta["alphabet"], meta["integer"])
    layers = tuple(meta["layers"])
    rows = sorted((r["i"], r["w"]) for r in parts["weights"].collect())
    if [i for i, _ in rows] != list(range(sum((a + 1) * b for a, b in zip(layers, layers[1:])))):
        raise ValueError("weights are missing or doubled")
    return MLPModel(meta["length"], meta["alphabet"], layers, tuple(w for _, w in rows))


# --- models saved by MLlib ----------------------------------------------------------

def load_mllib_model(spark: SparkSession, uri: str, spec: SequenceSpec = SequenceSpec()) -> LinearModel | MLPModel:
    """A classifier saved with MLlib's ``write().save(uri)``, alone or as the last stage of a pipeline model.

    The features are the one-hot cells ``pos * K + token``; if a ``CountVectorizerModel`` over cell ids comes
    before the classifier, its vocabulary says which feature is which cell.  Binary logistic regression becomes a
    :class:`LinearModel`, a two-class multilayer perceptron an :class:`MLPModel`."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegressionModel, MultilayerPerceptronClassificationModel
    from pyspark.ml.feature import CountVectorizerModel

    kinds = {c.__name__: c for c in (PipelineModel, LogisticRegressionModel, MultilayerPerceptronClassificationModel)}
    saved = json.loads(spark.read.text(f"{uri.rstrip('/')}/metadata").first()[0])["class"].rsplit(".", 1)[-1]
    if saved not in kinds:
        raise ValueError(f"{uri}: a {saved} is no model of sequences")
    loaded = kinds[saved].load(uri)
    stages = loaded.stages if saved == "PipelineModel" else [loaded]
    model = stages[-1]
    cells = next(([int(v) for v in s.vocabulary] for s in stages[:-1] if isinstance(s, CountVectorizerModel)), None)
    size = spec.length * spec.alphabet
    order = np.arange(size) if cells is None else np.argsort(np.asarray(cells))
    if cells is not None and sorted(cells) != list(range(size)) or model.numFeatures != size:
        raise ValueError(f"{uri}: the model has not the {size} features of {spec.length} positions and {spec.alphabet} tokens")
    if model.numClasses != 2:
        raise ValueError(f"{uri}: the model has {model.numClasses} classes")
    if isinstance(model, LogisticRegressionModel):
        matrix, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        # The multinomial form has a row per class; only their difference matters.
        w, b = (matrix[1] - matrix[0], intercepts[1] - intercepts[0]) if len(matrix) == 2 else (matrix[0], intercepts[0])
        return LinearModel(spec.length, spec.alphabet, tuple(map(float, w[order])), float(b), integer=False)
    layers = tuple(model.getOrDefault("layers"))
    flat, first = model.weights.toArray(), layers[0] * layers[1]
    into = flat[:first].reshape(layers[0], layers[1])[order]
    return MLPModel(spec.length, spec.alphabet, layers, tuple(map(float, np.concatenate([into.ravel(), flat[first:]]))))


# --- fitted once ---------------------------------------------------------------------

def store_path(spark: SparkSession) -> str:
    return (spark.conf.get(STORE_CONF, None) or f"{ensure_checkpoint_dir(spark).rstrip('/')}/models").rstrip("/")


def fitted_once(rows: DataFrame, kind: str, options: dict, fit: Callable[[], LinearModel | MLPModel]) -> LinearModel | MLPModel:
    """The model that ``fit`` gives, loaded if it was fitted before.

    The key is a digest of the training rows (one pass over them, whatever their order), the kind and the options.  A
    store entry is a bundle, so a fit that was cut short or damaged is fitted again."""
    spark = rows.sparkSession
    text = json.dumps([kind, options, rows.schema.jsonValue(), table_digest(rows)], sort_keys=True, default=str)
    path = f"{store_path(spark)}/{kind}-{hashlib.md5(text.encode()).hexdigest()}"
    try:
        return model_from_parts(read_bundle(spark, path))
    except IncompleteBundle:
        model = fit()
        write_bundle(spark, path, model_parts(spark, model))
        return model
