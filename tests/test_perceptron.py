import numpy as np
import pytest
from pyspark.sql import functions as F

from seqflip.operators import train as T
from seqflip.operators.perceptron import even_parts, mean_loss, packed_blocks, starting_weights
from seqflip.session import scratch_path
from seqflip.spec import SequenceSpec

SPEC = SequenceSpec(length=5, alphabet=4, start=0, active=1)


def windows(spark, n=700, parts=3):
    rng = np.random.default_rng(4)
    rows = [(i, [int(x) for x in rng.integers(0, 4, 5)]) for i in range(n)]
    return spark.createDataFrame([(i, t, int(t[0] + t[2] > 3)) for i, t in rows], "id BIGINT, tokens ARRAY<INT>, label INT").repartition(parts, "id")


def mllib(df, layers, max_iter):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    data = T.one_hot_features(df.select("tokens", F.col("label").cast("double").alias("label")), SPEC)
    return MultilayerPerceptronClassifier(layers=layers, maxIter=max_iter, seed=3).fit(data)


def test_fit_takes_mllibs_path_without_its_dense_rows(spark, monkeypatch):
    df = windows(spark).cache()
    theirs = mllib(df, [20, 6, 3, 2], 25)
    # MLlib's own fit holds each window as a dense row in every pass; ours must not go through it.
    monkeypatch.setattr(T, "one_hot_features", None)
    model, report = T.fit_mlp(df, SPEC, hidden=(6, 3), max_iter=25, seed=3)
    assert report.iterations == 25 and report.stopped == "max_iter"
    assert report.objective == pytest.approx(theirs.summary().objectiveHistory[-1], rel=1e-7)
    np.testing.assert_allclose(model.weights, theirs.weights.toArray(), atol=1e-6)


def test_rows_beside_the_grid_count_as_in_mllib(spark):
    odd = [([0, 1, 2, 3, 9], 1), ([0, None, 2], 0), ([3, 2, 1, 0, 1, 2, 3], 1), ([-1, 0, 0, -2, 5], 0)]
    df = spark.createDataFrame(odd * 70, "tokens ARRAY<INT>, label INT").coalesce(1).cache()
    model, _ = T.fit_mlp(df, SPEC, hidden=(3,), max_iter=8, seed=3)
    np.testing.assert_allclose(model.weights, mllib(df, [20, 3, 2], 8).weights.toArray(), atol=1e-6)


def test_gradient_by_central_differences(spark):
    layers = [20, 4, 2]
    loss = mean_loss(packed_blocks(windows(spark, 300), SPEC, "tokens", "label", scratch_path(spark, "blocks")), layers)
    w = starting_weights(spark, layers, 1)
    gradient = loss(w)[1]
    for i in (0, 19, 50, 81, 85, len(w) - 1):
        d = np.zeros(len(w))
        d[i] = 1e-5
        assert gradient[i] == pytest.approx((loss(w + d)[0] - loss(w - d)[0]) / 2e-5, abs=1e-8)


def test_passes_run_over_even_parts(spark, monkeypatch):
    monkeypatch.setattr("seqflip.operators.perceptron.PART_BLOCKS", 2)
    packed = packed_blocks(windows(spark, 1500, 1), SPEC, "tokens", "label", scratch_path(spark, "blocks"))
    even = even_parts(packed)
    layers = [20, 4, 2]
    w = starting_weights(spark, layers, 1)
    sizes = [r["n"] for r in even.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert packed.rdd.getNumPartitions() == 1 and len(sizes) == 6 and max(sizes) <= 3 and sum(sizes) == 12
    (one, slope), (whole, steep) = mean_loss(even, layers)(w), mean_loss(packed, layers)(w)
    assert one == pytest.approx(whole, rel=1e-12)
    np.testing.assert_allclose(slope, steep, atol=1e-14)
    even.unpersist()


@pytest.mark.parametrize("label", [None, 2])
def test_labels_other_than_the_two_are_refused(spark, label):
    with pytest.raises(Exception, match="label"):
        T.fit_mlp(spark.createDataFrame([([0, 1, 2, 3, 0], 1), ([0, 1, 2, 3, 1], label)], "tokens ARRAY<INT>, label INT"), SPEC, hidden=(2,), max_iter=2)
