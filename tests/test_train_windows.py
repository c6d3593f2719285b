from pyspark.sql import functions as F

from conftest import SF001
from seqflip.operators.prepare import validate_sequences
from seqflip.plans import documents as D
from seqflip.plans.documents import labelled
from seqflip.spec import SequenceSpec


def test_parts_of_a_fit_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(D, "FIT_CHARS", 20_000)
    windows = D.train_windows(spark, SF001)
    want = labelled(spark, SF001).where(F.col("split") == "train").select(windows.columns)
    assert windows.exceptAll(want).count() == want.exceptAll(windows).count() == 0
    rows = windows.groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) > 2 and max(r["count"] for r in rows) < want.count() / 2


def test_checked_tokens_are_computed_once(spark):
    from seqflip.functions.encode import csv_to_tokens

    df = spark.createDataFrame([(1, "0,1"), (2, "0,77")], "id INT, line STRING").select("id", csv_to_tokens("line").alias("tokens"))
    good, bad = validate_sequences(df, SequenceSpec(length=2, alphabet=2, start=0, active=1))
    assert [r["id"] for r in good.collect()] == [1] and [r["reason"] for r in bad.collect()] == ["bad_token"]
    plan = bad._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
