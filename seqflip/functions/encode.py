"""Token encodings as column expressions (JVM-side, no Python per row).

Arrays are the storage form (``tokens ARRAY<INT>``); the long form
``(keys..., pos, token)`` and the one-hot forms are derived on demand.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def default_vocab(k: int) -> list[str]:
    """Caller-neutral alphabet: the first ``k`` symbols of a-z, then A-Z."""
    letters = [chr(ord("a") + i) for i in range(26)] + [chr(ord("A") + i) for i in range(26)]
    if k > len(letters):
        raise ValueError("default vocabulary has 52 symbols; pass your own for a larger alphabet")
    return letters[:k]


def csv_to_tokens(c) -> Column:
    """``"3,4,17"`` -> ``[3, 4, 17]`` (blank fields become NULL)."""
    return F.split(_col(c), ",").try_cast("array<int>")


def tokens_to_csv(c) -> Column:
    """``[3, 4, 17]`` -> ``"3,4,17"``."""
    return F.array_join(_col(c).cast("array<string>"), ",")


def tokens_to_symbols(c, vocab: Sequence[str]) -> Column:
    """Token list -> symbol string through the (bounded, K-entry) vocabulary."""
    v = F.array(*[F.lit(s) for s in vocab])
    return F.array_join(F.transform(_col(c), lambda t: F.element_at(v, t + 1)), "")


def symbols_to_tokens(c, vocab: Sequence[str]) -> Column:
    """Symbol string -> token list; an unknown symbol becomes -1 (see validation)."""
    v = F.array(*[F.lit(s) for s in vocab])
    return F.transform(F.split(_col(c), ""),
                       lambda ch: (F.array_position(v, ch) - 1).cast("int"))


def char_tokens(text, k: int) -> Column:
    """Every character of a text -> ``code point % k`` (whole text, by code point)."""
    return F.transform(F.split(_col(text), ""), lambda ch: (F.ascii(ch) % k).cast("int"))


def one_hot_dense(c, k: int) -> Column:
    """Tokens -> flattened L*K one-hot ``ARRAY<DOUBLE>`` (position-major)."""
    rows = F.array(*[F.array(*[F.lit(1.0 if b == t else 0.0) for b in range(k)]) for t in range(k)])
    none = F.array(*[F.lit(0.0)] * k)
    # One look-up in a constant table a token, not k comparisons; a token outside it sets nothing.
    return F.flatten(F.transform(_col(c), lambda t: F.coalesce(F.get(rows, t), none)))


def _first_largest(scores: pa.ListArray, k: int) -> pa.ListArray:
    """Per list its arg-max tokens: for each ``k`` entries the first of the largest; NaN is the largest, nulls are none."""
    ends = scores.offsets.to_numpy().astype(np.int64)
    sizes = pc.fill_null(pc.list_value_length(scores), 0).to_numpy(zero_copy_only=False).astype(np.int64) // k
    values = scores.values
    # Lists that fill their rows and follow one another are one matrix.
    if scores.null_count == 0 and (sizes * k == np.diff(ends)).all():
        values = values.slice(ends[0], ends[-1] - ends[0])
    else:
        starts = np.repeat(ends[:-1] - k * (np.cumsum(sizes) - sizes), k * sizes)
        values = values.take(pa.array(starts + np.arange(len(starts))))
    if values.null_count or not (pa.types.is_floating(values.type) or pa.types.is_integer(values.type)):
        rows = [values.slice(at, k).to_pylist() for at in range(0, len(values), k)]
        rank = lambda v: (v != v, 0 if v != v else v)
        tokens = pa.array([max((b for b in range(k) if r[b] is not None), key=lambda b: rank(r[b]), default=None) for r in rows], pa.int32())
    else:
        tokens = pa.array(values.to_numpy(zero_copy_only=False).reshape(-1, k).argmax(axis=1).astype(np.int32))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), tokens)


def one_hot_to_tokens(c, k: int) -> Column:
    """Flattened one-hot (or any score matrix) -> arg-max token per position."""
    v = _col(c)
    n_pos = (F.size(v) / k).cast("int")
    # A list shorter than one position keeps to the general expression; the others go through Arrow, as a slice for each position
    # copies every score as an object.
    rows = F.transform(F.sequence(F.lit(0), n_pos - 1), lambda i: F.slice(v, i * k + 1, k))
    short = F.transform(rows, lambda r: (F.array_position(r, F.array_max(r)) - 1).cast("int"))

    @F.arrow_udf("array<int>")
    def tokens(scores: pa.Array) -> pa.Array:
        return _first_largest(scores, k)

    return F.when(F.size(v) >= k, tokens(v)).otherwise(short)


def one_hot_long(df: DataFrame, keys: Sequence[str], k: int, tokens: str = "tokens") -> DataFrame:
    """Sparse one-hot: one row ``(keys..., pos, token, feature, value)`` per position."""
    return (df.select(*keys, F.posexplode_outer(tokens).alias("pos", "token"))
              .select(*keys, "pos", "token", (F.col("pos") * k + F.col("token")).alias("feature"),
                      F.lit(1.0).alias("value")))


def to_long(df: DataFrame, keys: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """Array form -> long form ``(keys..., pos, token)``."""
    return df.select(*keys, F.posexplode_outer(tokens).alias("pos", "token"))


def to_array(long_df: DataFrame, keys: Sequence[str], length: int) -> DataFrame:
    """Long form -> array form; positions re-ordered.

    Positions outside ``[0, length)`` are left out (``bad_positions`` reports them) and repeated ``(keys, pos)`` rows
    reduce to their largest token map-side, so each gathered group holds at most
    ``length`` entries however many rows one key has; one shuffle on the keys."""
    pos = F.col("pos")
    per_pos = (long_df.where((pos >= 0) & (pos < length))
               .groupBy(*keys, "pos").agg(F.max("token").alias("token")))
    return (per_pos.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("_pt"))
            .select(*keys, F.col("_pt.token").alias("tokens")))


def bad_positions(long_df: DataFrame, length: int) -> DataFrame:
    """The rows that :func:`to_array` leaves out."""
    return long_df.where(F.col("pos").isNull() | (F.col("pos") < 0) | (F.col("pos") >= length))
