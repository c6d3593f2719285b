"""Sequence parameters, fixed values and table schemas.

A *sequence* is a fixed-length array of integer tokens ``0..K-1``.  Every
operator in the package works on a DataFrame with a ``tokens ARRAY<INT>``
column and passes all other columns (the sequence keys) through untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

# --- fixed values -----------------------------------------------------------
# Defaults that must equal the modelled workload for results to line up:
# sequence length 60, alphabet of 20 tokens, active segment starting at
# position 25 and 10 long, positive share 0.5, class signal 10, score
# threshold 0.9 (inclusive), at most 60 changes per sequence, 5 rounds in the
# fixed-round search, 80/10/10 split.
DEFAULT_LENGTH = 60
DEFAULT_ALPHABET = 20
DEFAULT_START = 25
DEFAULT_ACTIVE = 10
DEFAULT_P = 0.5
DEFAULT_CLASS_SIGNAL = 10.0
DEFAULT_THRESHOLD = 0.9
DEFAULT_CAP = 60
DEFAULT_ROUNDS = 5
SPLIT_BUCKETS = {"train": range(0, 8), "val": range(8, 9), "test": range(9, 10)}
# ---------------------------------------------------------------------------

DEFAULT_SEED = 42
# Integer models store log-odds as micro-logits so sums, gains and ties are
# exact integer arithmetic on every engine.
MICRO = 1_000_000


@dataclass(frozen=True)
class SequenceSpec:
    length: int = DEFAULT_LENGTH          # L
    alphabet: int = DEFAULT_ALPHABET      # K
    start: int = DEFAULT_START            # S, first active position
    active: int = DEFAULT_ACTIVE          # A, active segment length
    p: float = DEFAULT_P                  # share of class 1
    class_signal: float = DEFAULT_CLASS_SIGNAL
    threshold: float = DEFAULT_THRESHOLD  # search stops at score >= threshold
    cap: int = DEFAULT_CAP                # search stops after this many changes
    seed: int = DEFAULT_SEED

    def __post_init__(self):
        if self.length < 1 or self.alphabet < 2:
            raise ValueError("need length >= 1 and alphabet >= 2")
        if not (0 <= self.start and self.start + self.active <= self.length):
            raise ValueError("active segment must satisfy 0 <= start and start + active <= length")
        if not (0.0 < self.p < 1.0):
            raise ValueError("p must be in (0, 1)")
        if not (0.0 < self.threshold < 1.0):
            raise ValueError("threshold must be in (0, 1)")

    def with_(self, **kw) -> "SequenceSpec":
        return replace(self, **kw)

    @property
    def threshold_logit(self) -> float:
        return math.log(self.threshold / (1.0 - self.threshold))

    @property
    def threshold_micro(self) -> int:
        """Smallest integer micro-logit whose sigmoid reaches the threshold."""
        return math.ceil(MICRO * self.threshold_logit)
