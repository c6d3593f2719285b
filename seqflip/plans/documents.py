"""End-to-end plans over the document tables.

``documents`` -> whole-text windows -> hash split -> count-weight model from
the train split -> greedy search on every window of every label-0 document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import LinearModel
from ..operators.train import MLPModel, train_count_weights, train_logistic, train_mlp
from ..sources.documents import document_windows, labelled_documents
from ..sources.models import fitted_once
from ..sources.tables import read_table, spread
from ..spec import SequenceSpec

DOC_KEYS = ("doc_id", "win")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents(doc_id, text)``."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def labelled(spark: SparkSession, sf_dir: str, spec: SequenceSpec = SequenceSpec()) -> DataFrame:
    """``(doc_id, label, split, win, tokens)`` over every labelled document's whole text."""
    docs = labelled_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"), spec)
    return document_windows(spread(docs), spec, keep=("label", "split"))


def document_model(spark: SparkSession, sf_dir: str, spec: SequenceSpec = SequenceSpec()) -> LinearModel:
    """Count-weight model fitted on the train split of the labelled windows."""
    return train_count_weights(labelled(spark, sf_dir, spec).where(F.col("split") == "train"), spec)


MLP_ITER = 100
LR_ITER = 100


#: Characters of text whose windows are a part of a fit.  A solver holds every part's one-hot rows, some forty times the
#: text, and reads them again in each pass.
FIT_CHARS = 4_000_000


def train_windows(spark: SparkSession, sf_dir: str, spec: SequenceSpec = SequenceSpec()) -> DataFrame:
    """The windows of the train split for a fit, in parts of about ``FIT_CHARS`` however the table is split."""
    docs = labelled_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"), spec).where(F.col("split") == "train")
    parts = -(-(docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0) // FIT_CHARS)
    return document_windows(docs.repartition(parts) if parts > 1 else spread(docs), spec, keep=("label", "split"))


def train_documents(spark: SparkSession, sf_dir: str, spec: SequenceSpec = SequenceSpec()) -> DataFrame:
    """The documents of the train split, whole; their digest is the key of fitted models."""
    docs = labelled_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"), spec)
    return docs.where(F.col("split") == "train").select("doc_id", "label", "text")


def document_mlp(spark: SparkSession, sf_dir: str, spec: SequenceSpec = SequenceSpec()) -> MLPModel:
    """Multilayer perceptron of the train split; fitted by the first query that asks and loaded by the others."""
    return fitted_once(train_documents(spark, sf_dir, spec), "mlp", {"spec": repr(spec), "max_iter": MLP_ITER}, lambda: train_mlp(
        labelled(spark, sf_dir, spec).where(F.col("split") == "train"), spec, max_iter=MLP_ITER))


def document_logistic(spark: SparkSession, sf_dir: str, spec: SequenceSpec = SequenceSpec()) -> LinearModel:
    """Logistic regression of the train split; fitted by the first query that asks and loaded by the others."""
    return fitted_once(train_documents(spark, sf_dir, spec), "logistic", {"spec": repr(spec), "max_iter": LR_ITER}, lambda: train_logistic(
        train_windows(spark, sf_dir, spec), spec, max_iter=LR_ITER))


def search_input(spark: SparkSession, sf_dir: str, spec: SequenceSpec = SequenceSpec()) -> DataFrame:
    """Every window of every document labelled 0 (the filter reaches the labels scan)."""
    return labelled(spark, sf_dir, spec).where(F.col("label") == 0).select(*DOC_KEYS, "tokens")
