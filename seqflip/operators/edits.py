"""Hand-made edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_edits(df: DataFrame, edits: DataFrame, keys: Sequence[str], tokens: str = "tokens",
                *, length: int, order: str, out: str = "edited_tokens") -> DataFrame:
    """Apply ``edits(keys..., pos, token, order)`` to the sequences in ascending ``order``.

    Of several edits of one position the last one wins (ties: the largest token).
    Edits outside ``[0, length)`` cannot change a sequence and are left out before
    any shuffle; ``out_of_range_edits`` reports them.  The rest are reduced per
    ``(keys, pos)`` (map-side partial aggregation), then gathered per sequence - at
    most ``length`` entries per group however many edits one key has - and joined to
    the sequences once; the replacement itself is in-row."""
    keys = list(keys)
    valid = (F.col("pos") >= 0) & (F.col("pos") < length)
    per_pos = edits.where(valid).groupBy(*keys, "pos").agg(F.max(F.struct(order, "token"))["token"].alias("token"))
    per_seq = per_pos.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pos", "token"))).alias("_edits"))
    joined = df.join(per_seq, keys, "left")
    edited = F.transform(F.col(tokens), lambda t, i: F.coalesce(F.try_element_at(F.col("_edits"), i), t))
    return joined.withColumn(out, F.when(F.col("_edits").isNull(), F.col(tokens)).otherwise(edited)).drop("_edits")


def out_of_range_edits(edits: DataFrame, length: int) -> DataFrame:
    """The edits that :func:`apply_edits` leaves out, with the reason (as S15 quarantines sequences)."""
    reason = F.when(F.col("pos").isNull(), "null_position").when((F.col("pos") < 0) | (F.col("pos") >= length), "bad_position")
    return edits.withColumn("reason", reason).where("reason IS NOT NULL")


def score_edits(df: DataFrame, edits: DataFrame, keys: Sequence[str], model, spec, generator,
                order: str, tokens: str = "tokens") -> DataFrame:
    """Each edited sequence under the model and under a second one, the generator's posterior (a linear
    model too, see :func:`~seqflip.operators.generate.fit_posterior`), before and after."""
    from .score import linear_logit, sigmoid

    e = apply_edits(df, edits, keys, tokens, out="_after", length=spec.length, order=order)

    def gen(c):
        return sigmoid(linear_logit(c, generator), generator)

    return e.select(*keys,
                    sigmoid(linear_logit(tokens, model), model).alias("model_before"),
                    sigmoid(linear_logit("_after", model), model).alias("model_after"),
                    gen(tokens).alias("gen_before"), gen("_after").alias("gen_after"))
