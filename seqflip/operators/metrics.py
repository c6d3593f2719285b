"""Search metrics (M1-M4): global aggregates with map-side partial results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_changes(state: DataFrame) -> DataFrame:
    """M1: mean changes per trajectory."""
    return state.agg(F.avg(F.col("total_changes").cast("double")).alias("mean_changes"))


def max_changes(state: DataFrame) -> DataFrame:
    """M2: largest number of changes of one trajectory."""
    return state.agg(F.max("total_changes").alias("max_changes"))


def mean_change_time(changes: DataFrame, time_col: str = "time_s") -> DataFrame:
    """M3: mean seconds per change of a change log (rows without a time are skipped)."""
    return changes.agg(F.avg(time_col).alias("mean_change_s"), F.count(time_col).alias("timed_changes"))


def mean_trajectory_time(state: DataFrame, start: str = "start_ts", finish: str = "finish_ts") -> DataFrame:
    """M4: mean ``finish - start`` in minutes over finished trajectories."""
    secs = F.unix_micros(F.col(finish).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))
    return state.where(F.col(finish).isNotNull()).agg(
        (F.avg(secs) / 60e6).alias("mean_trajectory_min"), F.count(F.lit(1)).alias("finished"))


def search_metrics(state: DataFrame) -> DataFrame:
    """M1 + M2 with status counts, in one pass."""
    return state.agg(
        F.count(F.lit(1)).alias("sequences"),
        F.avg(F.col("total_changes").cast("double")).alias("mean_changes"),
        F.max("total_changes").alias("max_changes"),
        F.sum("total_changes").cast("bigint").alias("changes"),
        F.count_if(F.col("status") == "reached").alias("reached"),
        F.count_if(F.col("status") == "capped").alias("capped"),
        F.count_if(F.col("status") == "stuck").alias("stuck"),
        F.count_if(F.col("status") == "working").alias("working"))
