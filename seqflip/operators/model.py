"""Linear sequence model: the exchange format between training and search.

``z = bias + sum_i w[i, x_i]``, score ``sigmoid(z / scale)``.  Integer models
(``scale = 1e6``) hold micro-logits so every sum, gain and tie is exact; float
models (``scale = 1``) come from MLlib.

The weights are an ``L x K`` table - their size is fixed by the sequence
shape, never by the data - so the model is held on the driver like any fitted
MLlib model and enters plans as a literal array: scoring and search become
map-only expressions with no join and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import MICRO, SequenceSpec


def literal_array(values, sql_type: str) -> Column:
    """A constant array as one folded literal (a parsed string), not one expression per
    element: plan size and plan-building time stay flat however long the array is."""
    text = ",".join(repr(float(v)) if sql_type == "double" else str(int(v)) for v in values)
    return F.split(F.lit(text), ",").cast(f"array<{sql_type}>")


@dataclass(frozen=True)
class LinearModel:
    length: int
    alphabet: int
    weights: tuple          # flat, position-major: w[i, b] = weights[i*K + b]
    bias: float | int
    integer: bool = True

    def __post_init__(self):
        if len(self.weights) != self.length * self.alphabet:
            raise ValueError("weights must hold length * alphabet values")

    # --- plain accessors ---------------------------------------------------
    @property
    def scale(self) -> int:
        return MICRO if self.integer else 1

    @property
    def sql_type(self) -> str:
        return "bigint" if self.integer else "double"

    def w(self, i: int, b: int):
        return self.weights[i * self.alphabet + b]

    def best_tokens(self) -> list[int]:
        """Per position, the lowest token with the largest weight."""
        K = self.alphabet
        out = []
        for i in range(self.length):
            row = self.weights[i * K:(i + 1) * K]
            out.append(max(range(K), key=lambda b: (row[b], -b)))
        return out

    def best_weights(self) -> list:
        return [self.w(i, b) for i, b in enumerate(self.best_tokens())]

    def threshold(self, spec: SequenceSpec):
        """The stop threshold in model units (integer micro-logits or logits)."""
        return spec.threshold_micro if self.integer else spec.threshold_logit

    # --- literal arrays used in plans ---------------------------------------
    def _lit_array(self, values) -> Column:
        return literal_array(values, self.sql_type)

    def weight_array(self) -> Column:
        return self._lit_array(self.weights)

    def best_weight_array(self) -> Column:
        return self._lit_array(self.best_weights())

    def best_token_array(self) -> Column:
        return literal_array(self.best_tokens(), "int")

    def bias_lit(self) -> Column:
        return F.lit(self.bias).cast(self.sql_type)

    # --- tables --------------------------------------------------------------
    def to_df(self, spark: SparkSession) -> DataFrame:
        K = self.alphabet
        rows = [(i // K, i % K, self.weights[i]) for i in range(len(self.weights))]
        return spark.createDataFrame(rows, f"pos INT, token INT, w {self.sql_type.upper()}")

    @classmethod
    def from_df(cls, weights: DataFrame, bias, length: int, alphabet: int, integer: bool = True) -> "LinearModel":
        """Collect a weights table, which must have each of the ``length * alphabet`` cells once."""
        limit = length * alphabet
        rows = weights.select("pos", "token", "w").limit(limit + 1).collect()
        cells = {(r["pos"], r["token"]) for r in rows}
        if len(rows) != limit or cells != {(i, b) for i in range(length) for b in range(alphabet)}:
            raise ValueError(f"weights table must have each of the {limit} cells once; it has {len(rows)} rows, {len(cells)} cells")
        flat = [0] * limit if integer else [0.0] * limit
        for r in rows:
            flat[r["pos"] * alphabet + r["token"]] = int(r["w"]) if integer else float(r["w"])
        return cls(length, alphabet, tuple(flat), int(bias) if integer else float(bias), integer)
