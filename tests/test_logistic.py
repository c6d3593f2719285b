import numpy as np
import pytest
from pyspark.sql import functions as F

from seqflip.operators import train as T
from seqflip.operators.certify import logistic_certificate
from seqflip.spec import SequenceSpec

SPEC = SequenceSpec(length=5, alphabet=4, start=0, active=1)


def windows(spark, n=3000):
    rng = np.random.default_rng(4)
    rows = [(i, [int(x) for x in rng.integers(0, 4, 5)]) for i in range(n)]
    # Cell 11 never occurs, cell 16 always.
    rows = [(i, t[:2] + [min(t[2], 2), t[3], 0], int(t[0] + t[2] + rng.integers(0, 3) > 4)) for i, t in rows]
    return spark.createDataFrame(rows, "id BIGINT, tokens ARRAY<INT>, label INT").repartition(3, "id")


def mllib(df, **options):
    from pyspark.ml.classification import LogisticRegression

    data = T.one_hot_features(df.select("tokens", F.col("label").cast("double").alias("label")), SPEC)
    return LogisticRegression(standardization=False, family="binomial", **options).fit(data)


@pytest.mark.parametrize("reg, tol, max_iter", [(0.01, 1e-10, 500), (0.0, 1e-6, 100), (0.01, 1e-10, 4)])
def test_fit_takes_mllibs_path_without_its_one_hot_rows(spark, monkeypatch, reg, tol, max_iter):
    df = windows(spark).cache()
    theirs = mllib(df, regParam=reg, tol=tol, maxIter=max_iter)
    # MLlib's own fit holds each window as a sparse row of doubles; ours must not go through it.
    monkeypatch.setattr(T, "one_hot_features", None)
    model, report = T.fit_logistic(df, SPEC, max_iter=max_iter, reg_param=reg, tol=tol)
    np.testing.assert_allclose(model.weights, theirs.coefficients.toArray(), atol=1e-6)
    assert model.bias == pytest.approx(theirs.intercept, abs=1e-6)
    assert report.iterations == theirs.summary.totalIterations and report.max_iter == max_iter
    assert report.objective == pytest.approx(theirs.summary.objectiveHistory[-1], rel=1e-9)


def test_rows_beside_the_grid_count_as_in_mllib(spark):
    odd = [([0, 1, 2, 3, 9], 1), ([0, 1, 2], 0), ([3, 2, 1, 0, 1, 2, 3], 1), ([-1, 0, 0, -2, 5], 0), ([], 1), ([1, 1, 2, 3, 0], 0), ([0, 1, 2, 3, 9], 0)]
    df = spark.createDataFrame(odd * 70, "tokens ARRAY<INT>, label INT").coalesce(1).cache()
    model, _ = T.fit_logistic(df, SPEC, reg_param=0.01, tol=1e-10)
    theirs = mllib(df, regParam=0.01, tol=1e-10)
    np.testing.assert_allclose(model.weights, theirs.coefficients.toArray(), atol=1e-6)
    assert model.bias == pytest.approx(theirs.intercept, abs=1e-6)


def test_a_residual_is_computed_once_a_window(spark):
    model, _ = T.fit_logistic(windows(spark, 200), SPEC, reg_param=0.01)
    plan = logistic_certificate(windows(spark, 200), model, 0.01)._jdf.queryExecution().optimizedPlan().toString()
    # The score stands below the step that makes a row of each cell.
    above, below = plan.split("Generate explode", 1)
    assert "EXP(" not in above and below.count("EXP(") == 1
