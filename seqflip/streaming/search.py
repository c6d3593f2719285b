"""The search over a stream of sequences.

The search is per-sequence (no state across rows), so a stream needs no new
semantics: each micro-batch runs the same window-path plan and appends its
state rows and change rows to two sinks.  ``foreachBatch`` gives exactly-once
output when the sink write is idempotent per ``batch_id`` (parquet under a
batch-id partition here) and the checkpoint location is durable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.model import LinearModel
from ..operators.search import change_log, greedy_search
from ..spec import SequenceSpec


def search_batch(batch: DataFrame, batch_id: int, model: LinearModel, spec: SequenceSpec, keys: Sequence[str],
                 state_path: str, changes_path: str, tokens: str = "tokens") -> None:
    """Search one micro-batch; write its state and change rows under ``batch_id``."""
    st = greedy_search(batch, model, spec, tokens=tokens).persist()
    try:
        (st.drop("log").withColumn("batch_id", F.lit(batch_id))
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("batch_id").parquet(state_path))
        (change_log(st, keys, model).withColumn("batch_id", F.lit(batch_id))
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("batch_id").parquet(changes_path))
    finally:
        st.unpersist()


def start_search_stream(stream: DataFrame, model: LinearModel, spec: SequenceSpec, keys: Sequence[str],
                        state_path: str, changes_path: str, checkpoint_location: str,
                        tokens: str = "tokens", trigger: dict | None = None) -> StreamingQuery:
    """Run the greedy search on every micro-batch of ``stream``."""
    writer = (stream.writeStream
              .foreachBatch(lambda b, i: search_batch(b, i, model, spec, keys, state_path, changes_path, tokens))
              .option("checkpointLocation", checkpoint_location))
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
