from pyspark.sql import functions as F

from conftest import SF001
from seqflip.operators.search import change_log, greedy_search
from seqflip.plans.documents import document_model, search_input
from seqflip.session import scratch_path
from seqflip.spec import SequenceSpec
from seqflip.streaming.search import start_search_stream


def test_stream_equals_batch(spark):
    spec = SequenceSpec()
    model = document_model(spark, SF001, spec)
    si = search_input(spark, SF001, spec)
    src = scratch_path(spark, "stream-src")
    si.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(si.schema).option("maxFilesPerTrigger", 1).parquet(src)
    state_p, changes_p = scratch_path(spark, "stream-state"), scratch_path(spark, "stream-changes")
    q = start_search_stream(stream, model, spec, ["doc_id", "win"], state_p, changes_p,
                            scratch_path(spark, "stream-ckpt"), trigger={"availableNow": True})
    q.awaitTermination(600)
    got = spark.read.parquet(changes_p).drop("batch_id")
    want = change_log(greedy_search(si, model, spec), ["doc_id", "win"], model)
    cols = ["doc_id", "win", "change_num", "position", "prev_token", "new_token", "new_z"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())
    assert spark.read.parquet(state_p).count() == si.count()
