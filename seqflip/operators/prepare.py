"""Table preparation (S12-S16): label filter, ids, head sample, validation, partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import persisted, scratch_path
from ..spec import SequenceSpec


def filter_label(df: DataFrame, label: int = 0, col: str = "label") -> DataFrame:
    """Keep one class and drop the label (a column predicate, pushed to the scan)."""
    return df.where(F.col(col) == label).drop(col)


def _framed(c: str) -> Column:
    """A value with its length in front, or ``n`` for null: no two lists of values join to the same text."""
    text = F.col(c).cast("string")
    return F.when(text.isNull(), "n").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def assign_id(df: DataFrame, keys: Sequence[str], col: str = "seq_id") -> DataFrame:
    """A stable id per row, map-only: the MD5 of its natural key.  It depends neither on the
    partitioning nor on a task's retry; rows of equal keys share an id.  Nulls and values that hold any
    separator stay apart."""
    return df.withColumn(col, F.md5(F.concat(*[_framed(k) for k in keys])))


#: Rows that are numbered together: 2^16 neighbours of one partition.
SLICE_BITS = 16


def assign_line_id(lines: DataFrame, line: str = "value", col: str = "seq_id") -> DataFrame:
    """S13 where no key exists: unique ids for bare lines, ``md5(md5(line) # ordinal among equal lines)``.

    The set of ids depends on the lines only, not on their order or partitioning.  The rows are written once with
    their place.  Equal lines are counted per slice of ``2^SLICE_BITS`` neighbouring rows, prefix sums over a line's slices
    give each slice its first ordinal, and a window numbers the equal lines within a slice.  So no
    group holds more rows than a slice, whatever share of all rows one line has.  Null lines are equal lines."""
    spark = lines.sparkSession
    path = scratch_path(spark, "lines")
    placed = lines.withColumn("_digest", F.md5(_framed(line))).withColumn("_row", F.monotonically_increasing_id())
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path).withColumn("_slice", F.shiftright("_row", SLICE_BITS))
    before = Window.partitionBy("_digest").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = (rows.groupBy("_digest", "_slice").agg(F.count(F.lit(1)).alias("_n"))
             .select("_digest", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    within = F.row_number().over(Window.partitionBy("_digest", "_slice").orderBy("_row")) - 1
    ordinal = (F.col("_first") + F.col("_within")).cast("string")
    return (rows.withColumn("_within", within).join(first, ["_digest", "_slice"])
            .select(*lines.columns, F.md5(F.concat("_digest", F.lit("#"), ordinal)).alias(col)))


def sample_head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows by a key (a top-k, not a full sort)."""
    return df.orderBy(*order).limit(n)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that a filter above reads as values.  Without it the optimiser puts their expressions in place
    of them, in the filter below and once for each time that it names them."""
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    kept = [F.col(c) for c in df.columns if c not in columns]
    # The outer form has no inferred filter that would compute the array once more; the array always has one entry.
    return df.select(*kept, F.explode_outer(one).alias("_once")).select(*kept, *[F.col("_once")[n].alias(n) for n in columns])


def validity(tokens, spec: SequenceSpec = SequenceSpec()) -> F.Column:
    """``NULL`` when valid, else the reason: ``null``, ``bad_length`` or ``bad_token``."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    bad_tok = F.exists(t, lambda x: x.isNull() | (x < 0) | (x >= spec.alphabet))
    return (F.when(t.isNull(), "null").when(F.size(t) != spec.length, "bad_length")
            .when(bad_tok, "bad_token"))


def validate_sequences(df: DataFrame, spec: SequenceSpec = SequenceSpec(), tokens: str = "tokens",
                       mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """Split into ``(valid, quarantine)``; ``mode='raise_error'`` fails the job instead."""
    order = df.columns
    checked = computed_once(df, **{tokens: F.col(tokens)}).select(*order).withColumn("_reason", validity(tokens, spec))
    if mode == "raise_error":
        # A filter, because a column that is dropped would never be computed.
        stop = F.raise_error(F.concat(F.lit("invalid sequence: "), F.col("_reason"))).cast("boolean")
        return checked.where(F.when(F.col("_reason").isNotNull(), stop).otherwise(True)).drop("_reason"), df.limit(0)
    if mode != "quarantine":
        raise ValueError("mode is 'quarantine' or 'raise_error'")
    valid = checked.where(F.col("_reason").isNull()).drop("_reason")
    quarantine = checked.where(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason")
    return valid, quarantine


def repartition_cache(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Hash-partition by the whole sequence key (one document can hold a third of all windows, its windows then go to
    many tasks) and keep it in memory for repeated passes; the open :class:`~seqflip.session.Scope` releases it, or
    the caller with ``unpersist``."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return persisted(df.repartition(n, *keys))
