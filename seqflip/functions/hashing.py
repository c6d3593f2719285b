"""Deterministic pseudo-randomness from keys (never ``rand()`` in tested paths).

A draw is the first 32 bits of ``md5(concat_ws('|', seed, key...))`` - the same
value on every engine, every partitioning and every retry of a lost task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 1 << 32


def hash32(*parts) -> Column:
    """Unsigned 32-bit draw in ``[0, 2^32)`` from the md5 of the joined parts."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    key = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def split_bucket(seed: int, key) -> Column:
    """Bucket 0..9 of a key; 0-7 train, 8 val, 9 test."""
    return (hash32(seed, key) % 10).cast("int")


def split_name(seed: int, key) -> Column:
    b = split_bucket(seed, key)
    return F.when(b < 8, "train").when(b == 8, "val").otherwise("test")
