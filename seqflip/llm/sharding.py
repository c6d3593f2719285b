"""Sharding by weighted rendezvous hashing.

Every (record key, shard) pair gets a hash ``u`` in (0, 1) that nothing else influences; the record goes to the
shard with the greatest ``ln(u) / weight``.  A new shard can only win records for itself, so growing moves a
share of ``weight / total`` records and no others.  All of it is column expressions; slots inside a shard come from
one range shuffle, so a shard of any size is numbered by many tasks.

Defined cases: a null key hashes like a key of its own (one stable shard); a null text has no bytes; repeated rows
and keys each get a slot of their own; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Bytes that a record takes besides its text.
RECORD_OVERHEAD = 16


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard (0 ..) of ``key`` over shards with the given positive weights."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    text = key.cast("string")

    def score(shard: Column, weight: Column) -> Column:
        # The top 52 bits as a fraction strictly between 0 and 1.
        u = (F.shiftrightunsigned(F.xxhash64(text, shard), 12).cast("double") + 0.5) / float(1 << 52)
        return F.struct((F.log(u) / weight).alias("score"), (-shard).alias("shard"))

    pairs = F.zip_with(F.array(*[F.lit(i) for i in range(len(weights))]), F.array(*[F.lit(float(w)) for w in weights]), score)
    return -F.array_max(pairs)["shard"]


def number_slots(rows: DataFrame, shard: str, order: Sequence[str]) -> DataFrame:
    """Add ``slot``: 0, 1, .. without gaps inside each shard, in the order given.

    ``rows`` must be a stored table.  Rows are range-partitioned by (shard, order), numbered per partition, and
    shifted by the counts of the partitions before: no task ever holds a shard."""
    sorted_rows = rows.repartitionByRange(shard, *order).sortWithinPartitions(shard, *order)
    schema = T.StructType([*sorted_rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])
    names = schema.fieldNames()

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            local = b.groupby(shard).cumcount() + b[shard].map(seen).fillna(0).astype("int64")
            for k, n in b[shard].value_counts().items():
                seen[k] = seen.get(k, 0) + n
            yield b.assign(_part=part, _local=local)[names]

    placed = stored(sorted_rows.mapInPandas(number, schema), "slots")
    counts = placed.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (placed.join(offsets, [shard, "_part"])
            .withColumn("slot", F.col("_local") + F.col("_offset")).drop("_part", "_local", "_offset"))


def shard_records(df: DataFrame, key: str, text: str, weights: Sequence[float],
                  grown_weight: float | None = None) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard): every record in its shard; ``grown_shard`` is its place
    once a shard of ``grown_weight`` is added (null without one)."""
    grown = (rendezvous(F.col(key), [*weights, grown_weight]) if grown_weight is not None
             else F.lit(None).cast("int"))
    scored = df.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"), grown.alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"))
    rows = stored(scored, "sharded")
    return number_slots(rows, "shard", [key, "text_crc32", "_row"]).drop("_row")
