"""Synthetic labelled sequences and the generator's exact posterior.

The generating model is a left-to-right chain whose only random transition is
one branch: before position ``S`` and from ``S+A`` on, tokens are drawn from a
background table; in ``[S, S+A)`` from the state-0 table (branch 0, label 0)
or from the ``A`` state-1 tables (branch 1, label 1).  So a draw is "label
first, then every position independently from that position's table", and the
class posterior only depends on the active segment:

    logit P(y=1 | x) = ln(p / (1-p)) + sum_j ln(e1[j, x_{S+j}] / e0[x_{S+j}])

Both are in-row expressions over ids taken from a real table (``spark.range``
works too): map-only, any size, and every draw is a hash of ``(seed, id, pos)``
so retries and re-partitioning reproduce the same data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import TWO32, hash32
from ..spec import MICRO, SequenceSpec
from .model import literal_array


@dataclass(frozen=True)
class Profile:
    """Emission tables: background (K), state 0 (K), state 1 (A x K)."""
    background: tuple
    state0: tuple
    state1: tuple

    def __post_init__(self):
        K = len(self.background)
        for row in (self.background, self.state0, *self.state1):
            if len(row) != K:
                raise ValueError("every emission table needs K entries")
            if abs(math.fsum(row) - 1.0) > 1e-9 or min(row) < 0:
                raise ValueError("emission tables must be probability distributions")

    @property
    def alphabet(self) -> int:
        return len(self.background)

    @property
    def active(self) -> int:
        return len(self.state1)

    @classmethod
    def build(cls, background, state0, motif, class_signal: float) -> "Profile":
        """G1: state-1 table ``j`` = ``(k * onehot(motif[j]) + state0) / (k + 1)``, ``k = class_signal``."""
        k = float(class_signal)
        K = len(state0)
        s1 = tuple(tuple((k * (1.0 if t == m else 0.0) + state0[t]) / (k + 1.0) for t in range(K)) for m in motif)
        return cls(tuple(float(x) for x in background), tuple(float(x) for x in state0), s1)

    @classmethod
    def neutral(cls, spec: SequenceSpec = SequenceSpec()) -> "Profile":
        """A domain-neutral profile: background rising ``(t+1)/N``, state 0 falling
        ``(K-t)/N``, motif ``0, 2, 4, ...`` (mod K) across the active segment."""
        K = spec.alphabet
        N = K * (K + 1) / 2
        bg = [(t + 1) / N for t in range(K)]
        s0 = [(K - t) / N for t in range(K)]
        motif = [(2 * j) % K for j in range(spec.active)]
        return cls.build(bg, s0, motif, spec.class_signal)

    # --- derived, bounded tables ------------------------------------------------
    def tables(self) -> list[tuple]:
        """Table index 0 = background, 1 = state 0, 2 + j = state-1 offset j."""
        return [self.background, self.state0, *self.state1]

    def thresholds(self) -> list[list[int]]:
        """Cumulative thresholds ``floor(cum * 2^32)``; the last forced to ``2^32``."""
        out = []
        for row in self.tables():
            cum = [math.floor(math.fsum(row[:t + 1]) * TWO32) for t in range(len(row))]
            cum[-1] = TWO32
            out.append(cum)
        return out

    def log_ratios(self) -> list[list[float]]:
        """``ln(e1[j, t] / e0[t])`` for the active offsets; every token needs a probability above 0 in both."""
        if min(min(row) for row in (self.state0, *self.state1)) <= 0:
            raise ValueError("a token of probability 0 has no log ratio; smooth the profile")
        return [[math.log(self.state1[j][t] / self.state0[t]) for t in range(self.alphabet)]
                for j in range(self.active)]

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [("background", 0, t, p) for t, p in enumerate(self.background)]
        rows += [("state0", 0, t, p) for t, p in enumerate(self.state0)]
        rows += [("state1", j, t, p) for j, r in enumerate(self.state1) for t, p in enumerate(r)]
        return spark.createDataFrame(rows, "segment STRING, offset INT, token INT, prob DOUBLE")


def position_segments(spec: SequenceSpec) -> list[tuple[int, str, int]]:
    """``(pos, segment, offset)``: background ``[0,S)``, active ``[S,S+A)``, background ``[S+A,L)``."""
    S, A = spec.start, spec.active
    return [(i, "active", i - S) if S <= i < S + A else (i, "background", 0) for i in range(spec.length)]


def label_draw(ids: Column, spec: SequenceSpec) -> Column:
    """Label 1 with probability ``p`` (the branch taken)."""
    return (hash32(spec.seed, ids, "y") < math.floor(spec.p * TWO32)).cast("int")


def _first_above(cum: list[int], lo: int, hi: int, u: str) -> str:
    """SQL for the smallest ``t`` in ``[lo, hi]`` with ``u < cum[t]`` (a balanced CASE tree)."""
    if lo == hi:
        return str(lo)
    mid = (lo + hi) // 2
    return f"CASE WHEN {u} < {cum[mid]} THEN {_first_above(cum, lo, mid, u)} ELSE {_first_above(cum, mid + 1, hi, u)} END"


def _inverse_cdf(tables: list[list[int]], lo: int, hi: int, t: str, u: str) -> str:
    if lo == hi:
        return _first_above(tables[lo], 0, len(tables[lo]) - 1, u)
    mid = (lo + hi) // 2
    return (f"CASE WHEN {t} <= {mid} THEN {_inverse_cdf(tables, lo, mid, t, u)} "
            f"ELSE {_inverse_cdf(tables, mid + 1, hi, t, u)} END")


def generate_sequences(ids: DataFrame, id_col: str, spec: SequenceSpec = SequenceSpec(),
                       profile: Profile | None = None) -> DataFrame:
    """``(seq_id, label, tokens)`` - one sequence per id of the input table.

    Token at ``pos`` = number of cumulative thresholds of that position's table
    that are <= the draw ``u``; the lookup is a balanced comparison tree over
    the profile's thresholds (about log2(K) comparisons, no per-threshold lambda)."""
    profile = profile or Profile.neutral(spec)
    if profile.alphabet != spec.alphabet or profile.active != spec.active:
        raise ValueError("profile does not match the sequence spec")
    S, A = spec.start, spec.active
    base = ids.select(F.col(id_col).cast("bigint").alias("seq_id")).withColumn("label", label_draw(F.col("seq_id"), spec))
    # One draw per position first (the hash is then read, not recomputed, by the lookup).
    draws = F.transform(F.sequence(F.lit(0), F.lit(spec.length - 1)), lambda i: hash32(spec.seed, F.col("seq_id"), i))
    # The emission table of each position, computed once per position (the lookup tree
    # then only reads lambda variables).
    table = (f"transform(sequence(0, {spec.length - 1}), i -> CASE WHEN i >= {S} AND i < {S + A} "
             f"THEN (CASE WHEN label = 1 THEN i - {S} + 2 ELSE 1 END) ELSE 0 END)")
    tables = profile.thresholds()
    lookup = _inverse_cdf(tables, 0, len(tables) - 1, "t", "u")
    tokens = F.expr(f"zip_with(_u, {table}, (u, t) -> CAST({lookup} AS INT))")
    return base.withColumn("_u", draws).withColumn("tokens", tokens).drop("_u")


def posterior_logit(tokens, spec: SequenceSpec = SequenceSpec(), profile: Profile | None = None) -> Column:
    """The generator's class-1 log-odds of a token sequence."""
    profile = profile or Profile.neutral(spec)
    K, S = spec.alphabet, spec.start
    lr = literal_array([v for row in profile.log_ratios() for v in row], "double")
    tok = F.col(tokens) if isinstance(tokens, str) else tokens
    active = F.slice(tok, S + 1, spec.active)
    prior = math.log(spec.p / (1.0 - spec.p))
    return F.aggregate(F.transform(active, lambda t, j: F.get(lr, j * K + t)), F.lit(prior), lambda a, x: a + x)


def generator_posterior(df: DataFrame, spec: SequenceSpec = SequenceSpec(), profile: Profile | None = None,
                        tokens: str = "tokens") -> DataFrame:
    """``posterior`` and ``gen_pred`` (1 iff posterior is strictly above 0.5)."""
    z = posterior_logit(tokens, spec, profile)
    return (df.withColumn("_gz", z)
              .withColumn("posterior", 1.0 / (1.0 + F.exp(-F.col("_gz"))))
              .withColumn("gen_pred", (F.col("_gz") > 0).cast("int"))
              .drop("_gz"))


def generator_error_rate(df: DataFrame, spec: SequenceSpec = SequenceSpec(), profile: Profile | None = None,
                         tokens: str = "tokens", label: str = "label") -> DataFrame:
    """Share of sequences whose inferred label differs from the drawn one."""
    scored = generator_posterior(df, spec, profile, tokens)
    return scored.agg(F.count(F.lit(1)).alias("n"),
                      F.sum((F.col(label) != F.col("gen_pred")).cast("bigint")).alias("errors"),
                      F.avg((F.col(label) != F.col("gen_pred")).cast("double")).alias("error_rate"))


def segment_frequencies(df: DataFrame, spec: SequenceSpec = SequenceSpec(), profile: Profile | None = None,
                        tokens: str = "tokens", label: str = "label") -> DataFrame:
    """G1/G2 check on data: per ``(label, segment, offset, token)`` the observed count and
    share next to the profile's probability.  Background positions pool into one
    table, label-0 active positions into ``state0``, label-1 active offsets stay apart.

    One partial aggregation (at most ``2 * (2 + A) * K`` groups) and a broadcast of the
    profile table, whose size is fixed by ``(2 + A) * K``."""
    from pyspark.sql.window import Window

    profile = profile or Profile.neutral(spec)
    segs = position_segments(spec)
    seg_arr = F.split(F.lit(",".join(seg for _, seg, _ in segs)), ",")
    off_arr = literal_array([off for _, _, off in segs], "int")
    long = (df.select(F.col(label).alias("label"), F.posexplode_outer(tokens).alias("pos", "token"))
            .where(F.col("pos").isNotNull()))
    in_active = F.get(seg_arr, F.col("pos")) == "active"
    seg = (F.when(~in_active, F.lit("background")).when(F.col("label") == 1, F.lit("state1"))
           .otherwise(F.lit("state0")))
    offset = F.when(in_active & (F.col("label") == 1), F.get(off_arr, F.col("pos"))).otherwise(0)
    counts = (long.groupBy("label", seg.alias("segment"), offset.cast("int").alias("offset"), "token")
              .agg(F.count(F.lit(1)).alias("n")))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("label", "segment", "offset"))
    return (counts.withColumn("share", share)
            .join(F.broadcast(profile.to_df(df.sparkSession)), ["segment", "offset", "token"], "left"))


def fit_posterior(train: DataFrame, spec: SequenceSpec = SequenceSpec(), tokens: str = "tokens", label: str = "label"):
    """G4 fitted to data: the class posterior of the segment model as a linear model.

    Outside the active segment both classes share the background, so those weights are 0.  At active offset ``j`` class
    1 has a table of its own and class 0 one table for all offsets::

        w = round(1e6 * (ln((n1[j, t] + 1) / (t1 + K)) - ln((n0[t] + 1) / (n0 + K))))

    One aggregation; ``L * K`` rows reach the driver."""
    from .model import LinearModel
    from .train import count_weight_table

    K, active = spec.alphabet, range(spec.start, spec.start + spec.active)
    cells = {(r["pos"], r["token"]): r for r in count_weight_table(train, spec, tokens, label).collect()}
    first = next(iter(cells.values()), None)
    if first is None or first["bias"] is None:
        raise ValueError("training data needs sequences of both classes")
    pooled = [sum(cells[i, t]["n0"] for i in active) for t in range(K)]
    total = sum(pooled)

    def w(i: int, t: int) -> int:
        if i not in active:
            return 0
        c = cells[i, t]
        return _half_up(MICRO * (math.log((c["n1"] + 1) / (c["t1"] + K)) - math.log((pooled[t] + 1) / (total + K))))

    return LinearModel(spec.length, K, tuple(w(i, t) for i in range(spec.length) for t in range(K)), int(first["bias"]))


def fit_profile(train: DataFrame, spec: SequenceSpec = SequenceSpec(), tokens: str = "tokens", label: str = "label") -> Profile:
    """G1 on data: background and state-0 tables are the smoothed token shares outside the active segment and of class 0
    inside it; the motif is class 1's most frequent token at each active offset (ties: the lowest); state 1 mixes
    the two by :meth:`Profile.build`.  One aggregation; ``L * K`` rows reach the driver."""
    from .train import count_weight_table

    K, active = spec.alphabet, range(spec.start, spec.start + spec.active)
    cells = {(r["pos"], r["token"]): r for r in count_weight_table(train, spec, tokens, label).collect()}

    def shares(counts: list[int]) -> list[float]:
        return [(c + 1) / (sum(counts) + K) for c in counts]

    outside = [sum(cells[i, t]["n1"] + cells[i, t]["n0"] for i in range(spec.length) if i not in active) for t in range(K)]
    state0 = [sum(cells[i, t]["n0"] for i in active) for t in range(K)]
    motif = [max(range(K), key=lambda t: (cells[i, t]["n1"], -t)) for i in active]
    return Profile.build(shares(outside), shares(state0), motif, spec.class_signal)


def _half_up(x: float) -> int:
    """Round to the nearest integer, halves away from zero (as SQL does)."""
    return int(math.copysign(math.floor(abs(x) + 0.5), x))
