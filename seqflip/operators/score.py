"""Scoring (P1-P4): model logit, class-1 score, search state, input gradient.

All expressions are in-row over ``tokens``: map-only, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import LinearModel


def _tok(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def position_weights(tokens, model: LinearModel) -> Column:
    """``[w[0, x_0], w[1, x_1], ...]``."""
    W, K = model.weight_array(), model.alphabet
    return F.transform(_tok(tokens), lambda t, i: F.get(W, i * K + t))


def linear_logit(tokens, model: LinearModel) -> Column:
    """``bias + sum_i w[i, x_i]`` in model units (micro-logits for integer models)."""
    zero = F.lit(0).cast(model.sql_type)
    return model.bias_lit() + F.aggregate(position_weights(tokens, model), zero, lambda a, x: a + x)


def sigmoid(z: Column, model: LinearModel) -> Column:
    return 1.0 / (1.0 + F.exp(-(z.cast("double") / model.scale)))


def score_sequences(df: DataFrame, model: LinearModel, tokens: str = "tokens",
                    z_col: str = "z", pred_col: str = "pred") -> DataFrame:
    """Add the logit and the class-1 score."""
    return (df.withColumn(z_col, linear_logit(tokens, model))
              .withColumn(pred_col, sigmoid(F.col(z_col), model)))


def score_selected(df: DataFrame, selection: DataFrame, keys: Sequence[str], model: LinearModel,
                   tokens: str = "tokens") -> DataFrame:
    """Score only the rows whose keys appear in ``selection`` (semi join)."""
    return score_sequences(df.join(selection.select(*keys).distinct(), list(keys), "left_semi"), model, tokens)


def init_search_state(df: DataFrame, model: LinearModel, tokens: str = "tokens",
                      with_times: bool = False) -> DataFrame:
    """``init_z, init_pred, current_z, current_pred, working, total_changes, status, log``."""
    z = linear_logit(tokens, model)
    log_type = f"array<struct<change_num:int,position:int,prev_token:int,new_token:int,new_z:{model.sql_type}>>"
    out = (df.withColumn("init_z", z)
             .withColumn("init_pred", sigmoid(F.col("init_z"), model))
             .withColumn("current_tokens", F.col(tokens))
             .withColumn("current_z", F.col("init_z"))
             .withColumn("current_pred", F.col("init_pred"))
             .withColumn("working", F.lit(True))
             .withColumn("status", F.lit("working"))
             .withColumn("total_changes", F.lit(0))
             .withColumn("log", F.expr(f"cast(array() as {log_type})")))
    if with_times:
        out = out.withColumn("start_ts", F.current_timestamp()).withColumn("finish_ts", F.lit(None).cast("timestamp"))
    return out


def input_gradient(df: DataFrame, keys: Sequence[str], model: LinearModel, tokens: str = "tokens") -> DataFrame:
    """Gradient of the target-0 cross-entropy w.r.t. the one-hot input,
    ``d loss / d x[i, b] = sigmoid(z) * w[i, b] / scale``, one row per (sequence, i, b)."""
    K = model.alphabet
    W = model.weight_array()
    s = sigmoid(linear_logit(tokens, model), model)
    scored = df.select(*keys, F.col(tokens).alias("_t"), s.alias("_s"))
    cells = F.sequence(F.lit(0), F.size("_t") * K - 1)
    return (scored.select(*keys, "_t", "_s", F.explode_outer(cells).alias("_c")).where(F.col("_c").isNotNull())
            .select(*keys, (F.col("_c") / K).cast("int").alias("pos"), (F.col("_c") % K).alias("token"),
                    F.get(F.col("_t"), (F.col("_c") / K).cast("int")).alias("current_token"),
                    (F.col("_s") * F.get(W, F.col("_c")).cast("double") / model.scale).alias("grad")))
