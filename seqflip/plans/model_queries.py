"""Model-slot and loop-path queries: literal-round search (P8-P10 loop path),
MLlib logistic regression (T3), multilayer perceptron (T5), the whole
pipeline (T7) and timing metrics (M3, M4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encode import tokens_to_csv
from ..operators.metrics import mean_change_time, mean_trajectory_time
from ..operators.nonlinear import mlp_accuracy_by_split, mlp_score, mlp_search_loop
from ..operators.search import greedy_search, linear_search_loop
from ..operators.train import accuracy_by_split, train_model
from ..operators.score import sigmoid
from ..session import scratch_path
from ..sources.tables import load_mlp_model, save_mlp_model
from ..sources.text import change_log_text, parse_change_log
from .documents import document_logistic, document_mlp, document_model, labelled, search_input, table
from . import oracle as O
from .registry import KEYS, SPEC, _with, r6, register
from .search_queries import _state_select, _state_sql

@register("search_until_done_loop", _state_sql(None))
def q_search_until_done_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 loop path: literal rounds until no row works; equals the window path."""
    model = document_model(spark, sf_dir, SPEC)
    return _state_select(linear_search_loop(search_input(spark, sf_dir, SPEC), model, SPEC))


@register("search_fixed_rounds_loop", _state_sql(5))
def q_search_fixed_rounds_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 loop path: exactly five literal rounds."""
    model = document_model(spark, sf_dir, SPEC)
    return _state_select(linear_search_loop(search_input(spark, sf_dir, SPEC), model, SPEC, rounds=5))


@register("train_pipeline", _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC)) + """,
zs AS (
  SELECT doc_id, win, split, label, (SELECT b FROM bias) + sum(wt.w) AS z
  FROM lpos JOIN wt ON lpos.pos = wt.pos AND lpos.token = wt.token GROUP BY doc_id, win, split, label)
SELECT split, CAST(count(*) AS BIGINT) AS n,
       round(avg(CASE WHEN (CASE WHEN z > 0 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END), 9) AS accuracy
FROM zs GROUP BY split""")
def q_train_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows -> split -> train (model chosen by name) -> accuracy per split."""
    return _pipeline(spark, sf_dir, "count")


def _pipeline(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    data = labelled(spark, sf_dir, SPEC)
    model = document_logistic(spark, sf_dir, SPEC) if kind == "lr" else train_model(data.where(F.col("split") == "train"), kind, SPEC)
    return accuracy_by_split(data, model).withColumn("accuracy", F.round("accuracy", 9))


@register("train_pipeline_logistic")
def q_train_pipeline_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 + T6 + T7: the same with logistic regression; its train, validation and test accuracy."""
    return _pipeline(spark, sf_dir, "lr")


@register("train_logistic")
def q_train_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLlib logistic regression on the one-hot windows; its weights table."""
    model = document_logistic(spark, sf_dir, SPEC)
    return model.to_df(spark).withColumn("bias", F.lit(model.bias))


@register("logistic_search")
def q_logistic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 -> P10: the window search driven by the MLlib logistic model (float logits)."""
    model = document_logistic(spark, sf_dir, SPEC)
    st = greedy_search(search_input(spark, sf_dir, SPEC), model, SPEC)
    return st.select(*KEYS, tokens_to_csv("current_tokens").alias("current_tokens"), r6("init_pred").alias("init_pred"),
                     r6("current_pred").alias("current_pred"), "total_changes", "status")


@register("train_mlp")
def q_train_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 + T6: MLlib multilayer perceptron (L*K -> 32 -> 16 -> 2); accuracy per split."""
    return mlp_accuracy_by_split(labelled(spark, sf_dir, SPEC), document_mlp(spark, sf_dir, SPEC)).withColumn("accuracy", F.round("accuracy", 9))


@register("mlp_search")
def q_mlp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 with the non-linear model: five literal rounds, gradient by numpy back-propagation
    in Arrow batches over the rows still working."""
    model = document_mlp(spark, sf_dir, SPEC)
    st = mlp_search_loop(search_input(spark, sf_dir, SPEC), model, SPEC, rounds=5)
    return st.select(*KEYS, tokens_to_csv("current_tokens").alias("current_tokens"), r6("init_pred").alias("init_pred"),
                     r6("current_pred").alias("current_pred"), "total_changes", "status", "working")


#: Made-up seconds of a change, from its place: a supplied log has times that any engine can recompute.
def _seconds(k, pos):
    return (k * 7 + pos * 3) % 1000 / F.lit(1000.0)


@register("mean_change_time", _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC), O.search_ctes(SPEC)) + """
SELECT round(avg(((k - 1) * 7 + pos * 3) % 1000 / 1000.0), 9) AS mean_change_s, count(*) AS timed_changes FROM kept""")
def q_mean_change_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: mean seconds per change of a supplied text log whose lines carry a time (written and parsed back, S10)."""
    model = document_model(spark, sf_dir, SPEC)
    st = greedy_search(search_input(spark, sf_dir, SPEC), model, SPEC)
    timed = F.transform("log", lambda e: e.withField("time_s", _seconds(e["change_num"], e["position"])))
    text = st.select(*KEYS, change_log_text(timed, lambda z: sigmoid(z, model), times=True).alias("change_log"))
    m = mean_change_time(parse_change_log(text, KEYS))
    return m.withColumn("mean_change_s", F.round("mean_change_s", 9))


@register("mean_trajectory_time", """
SELECT round(avg(us) / 60e6, 6) AS mean_trajectory_min, count(*) AS finished
FROM (SELECT epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY user_id)""")
def q_mean_trajectory_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: mean minutes from start to finish of a supplied table of trajectories: each user's first and last event."""
    t = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("finish_ts"))
    return mean_trajectory_time(t).withColumn("mean_trajectory_min", F.round("mean_trajectory_min", 6))


@register("load_mlp_scores")
def q_load_mlp_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + S11 for the non-linear model: saved, loaded by path, and every labelled window scored with it."""
    data = labelled(spark, sf_dir, SPEC)
    path = scratch_path(spark, "mlp")
    save_mlp_model(document_mlp(spark, sf_dir, SPEC), spark, path)
    return mlp_score(data, load_mlp_model(spark, path)).select(*KEYS, "label", "split", r6("pred").alias("pred"))


@register("mlp_search_until_done")
def q_mlp_search_until_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 with the non-linear model: rounds until no window is working."""
    model = document_mlp(spark, sf_dir, SPEC)
    st = mlp_search_loop(search_input(spark, sf_dir, SPEC), model, SPEC)
    return st.select(*KEYS, tokens_to_csv("current_tokens").alias("current_tokens"), r6("init_pred").alias("init_pred"),
                     r6("current_pred").alias("current_pred"), "total_changes", "status", "working")
